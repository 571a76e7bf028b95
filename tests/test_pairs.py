import random

from contactloom.operators import pairs
from contactloom.sources.reads import PAIRS


def pair(name, c1, p1, s1, rs1, re1, c2, p2, s2, rs2, re2, n=50):
    return (name, c1, p1, s1, n, rs1, re1, c2, p2, s2, n, rs2, re2)


def flags(spark, rows, **options):
    df = spark.createDataFrame(rows, PAIRS)
    return {r.read_id: r.flag for r in pairs.classify(df, over_represented=0.0, **options).collect()}


def test_planted_classes_are_found(spark):
    rng, rows = random.Random(1), []
    for k in range(50):
        a = 100_000 * k + 10_000
        frag = (a, a + 3000)
        x = a + 200 + rng.randrange(100)
        rows += [
            pair(f"self{k}", "1", x, 0, *frag, "1", x + 400, 1, *frag),
            pair(f"dangling{k}", "1", x, 1, *frag, "1", x + 400, 0, *frag),
            pair(f"error{k}", "1", x, 1, *frag, "1", x + 401, 1, *frag),
            pair(f"extra{k}", "1", a + 2900, 1, *frag, "1", a + 3100, 0, a + 3000, a + 6000),
            pair(f"valid{k}", "1", x, 1, *frag, "2", x + 9, 0, *frag),
        ]
    found = flags(spark, rows)
    want = {"self": 1, "dangling": 2, "error": 4, "extra": 8, "valid": 1024}
    for name, flag in found.items():
        kind = name.rstrip("0123456789")
        assert flag & (15 | 1024) == want[kind], name


def test_site_filters(spark):
    rows = [
        pair("close", "1", 103, 1, 100, 2000, "2", 700, 1, 100, 2000),
        pair("close~1~", "1", 104, 1, 100, 2000, "2", 701, 1, 100, 2000),
        pair("short", "1", 150, 1, 100, 190, "2", 702, 1, 100, 2000),
        pair("large", "1", 600, 1, 100, 200_000, "2", 703, 1, 100, 2000),
        pair("far", "1", 1000, 1, 100, 2000, "2", 704, 1, 100, 2000),
    ]
    found = {k: v & (16 | 32 | 64 | 512) for k, v in flags(spark, rows).items()}
    assert found == {"close": 16, "close~1~": 0, "short": 32, "large": 64, "far": 512}


def test_duplicates_and_strict_lengths(spark):
    rows = [pair(f"d{k}", "1", 500, 1, 0, 4096, "1", 9000, 0, 8192, 12288, 50 + k // 2) for k in range(4)]
    assert [v >> 8 & 1 for _, v in sorted(flags(spark, rows).items())] == [0, 1, 1, 1]
    assert [v >> 8 & 1 for _, v in sorted(flags(spark, rows, strict_duplicates=True).items())] == [0, 1, 0, 1]


def test_rank_cut(spark):
    counts = [1, 1, 2, 2, 3, 5, 9, 9, 20, 40]
    df = spark.createDataFrame([(n,) for n in counts], "n long")
    for share in (0.0, 0.1, 0.25, 0.5, 0.95, 1.0):
        cut = int((1 - share) * len(counts) + 0.5)
        want = sorted(counts)[cut - 1]
        assert pairs.rank_cut(df, share).first()[0] == want


def test_masks_and_apply(spark):
    assert pairs.mask([1, 2, 9]) == 259
    df = spark.createDataFrame([("a", 0), ("b", 256), ("c", 1024)], "read_id string, flag int")
    assert {r[0] for r in pairs.apply_filter(df).collect()} == {"a", "c"}
    assert {r[0] for r in pairs.apply_filter(df, reverse=True).collect()} == {"b"}


def test_intersection_expands_multi_contacts(spark):
    schema = "name string, chrom string, pos long, strand int, len int, rs long, re long"
    one = [("r1", "1", 100, 1, 50, 0, 400), ("r2", "1", 100, 1, 50, 0, 400), ("r2~2~", "1", 900, 1, 40, 800, 1200), ("r3", "1", 5, 1, 9, 0, 400)]
    two = [("r1", "1", 5000, 0, 50, 4000, 6000), ("r2", "2", 70, 0, 50, 0, 300), ("r4", "2", 70, 0, 50, 0, 300)]
    found = pairs.intersect(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)).collect()
    names = sorted(r.read_id for r in found)
    assert names == ["r1", "r2#1/3", "r2#2/3", "r2#3/3"]
    assert all((r.c1, r.p1) <= (r.c2, r.p2) for r in found)


def test_oriented_by_chromosome_order(spark):
    df = spark.createDataFrame([pair("x", "10", 5, 1, 0, 9, "2", 7, 0, 0, 9)], PAIRS)
    order = spark.createDataFrame([("2", 0), ("10", 1)], "chrom string, ord int")
    assert pairs.oriented(df, order).first().c1 == "2"
    assert pairs.oriented(df).first().c1 == "10"


def test_empty_pairs(spark):
    df = spark.createDataFrame([], PAIRS)
    assert pairs.classify(df).count() == 0
    assert pairs.filter_counts(pairs.classify(df)).count() == 0


def test_flags_from_read_lists(spark):
    reads = spark.createDataFrame([("a",), ("b",), ("c",)], "read_id string")
    lists = {1: reads.where("read_id < 'c'"), 9: reads.where("read_id = 'b'")}
    assert {r.read_id: r.flag for r in pairs.flags_from_lists(reads, lists).collect()} == {"a": 1, "b": 257, "c": 0}
    assert pairs.flags_from_lists(reads, {}).where("flag <> 0").count() == 0


def test_unique_hits(spark):
    df = spark.createDataFrame([("1", 60), ("0:1", 3), ("2", 10), ("0", 0), ("1:2", 4), ("10", 1)], "hits string, mapq int")
    found = df.select("hits", pairs.uniquely_mapped(df.hits).alias("u"), pairs.uniquely_mapped(mapq=df.mapq).alias("q")).collect()
    assert {r.hits for r in found if r.u} == {"1", "0:1", "1:2"} and {r.hits for r in found if r.q} == {"1", "2", "1:2"}
