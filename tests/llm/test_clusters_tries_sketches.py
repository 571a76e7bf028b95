"""Centroid clustering, the prefix trie and MinHash components against plain versions, and on odd rows."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.llm import centroid_cluster, minhash_dedup, prefix_trie

# ---------------------------------------------------------------- centroids


def plain_clusters(rows, rounds=10, k=8):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        for k, vs in groups.items():
            centroids[k] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found), key=str)


def clustered(df, **options):
    rows = centroid_cluster.Clustering(df, **options).report().select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted(map(tuple, rows.collect()), key=str)


def vectors(n=160, seed=3):
    rng = random.Random(seed)
    centres = [[rng.choice([-1, 0, 1]) * rng.random() for _ in range(64)] for _ in range(5)]
    # Few values a component, so that distances tie.
    return [(k, [round(x + rng.choice([0, 0.25, -0.25]), 2) for x in rng.choice(centres)]) for k in range(n)]


def test_clusters_equal_the_plain_version_with_odd_rows(spark):
    rows = vectors()
    rows += [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (1004, [0.5] * 63 + [None]), (1005, [0.5] * 63 + [float("nan")]), (1006, [float("inf")] * 64)]
    rows += [(7, rows[7][1])] * 3 + [(None, rows[9][1]), (7, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert clustered(df) == plain_clusters(rows)
    assert clustered(df.withColumns({"id": F.lit("mine"), "cluster": F.lit(1), "v": F.lit(2)})) == plain_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors_give_few_clusters(spark, n):
    rows = vectors(n) + [(50, None)]
    assert clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain_clusters(rows)


def test_ties_go_to_the_smaller_number_and_huge_components_are_bounded(spark):
    same = [(k, [0.5] * 64) for k in range(20)]
    assert {r[1] for r in clustered(spark.createDataFrame(same, "vec_id long, embedding array<float>"))} == {0}
    huge = same[:9] + [(99, [1e300] * 64)]
    found = clustered(spark.createDataFrame(huge, "vec_id long, embedding array<double>"))
    assert len(found) == 10 and all(0 <= r[2] <= (1 << 62) for r in found)


def test_partial_distances_never_change_a_result():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-3, 4, (500, 64)), rng.integers(-3, 4, (8, 64))
    c[5] = c[2]
    whole = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    for order in (np.arange(64), rng.permutation(64)):
        cluster, distance = centroid_cluster.nearest(x, c, order)
        assert (cluster == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()


# ---------------------------------------------------------------- trie


def plain_trie(rows, shared=lambda c: zlib.crc32(str(c).encode()) % 9):
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append(((turn is not None, turn or 0, digest(role or "", text or "")), (role or "", text or "")))
    turns = {c: [t for _, t in sorted(v)] for c, v in said.items()}
    built = {c: turns.get(c - int(math.fmod(c, 5)), [])[: shared(c)] + t[shared(c) :] for c, t in turns.items()}
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        yield node
        for child in children[node]:
            yield from below(child)

    out = []
    for node, of in members.items():
        tree = list(below(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in tree if n)
        ends = ",".join(str(c) for c in sorted(of) if len(built[c]) == len(node))
        out.append(
            (min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), sum(not children[n] for n in tree), saved, hashlib.sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


def conversations(n=120, seed=4):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -5, -6]:
        for t in range(rng.randrange(1, 14)):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["", None, "é", "hello there", "a" * 50])))
    return rows + rows[:5] + [(None, 1, "user", "of nobody"), (903, 0, "user", "no family")]


def tried(df, **options):
    rows = prefix_trie.trie(prefix_trie.rebuilt(df), **options).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
    return sorted(map(tuple, rows.collect()), key=str)


def test_trie_equals_the_plain_version(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert tried(df) == plain_trie(rows)
    # Slices of three turns and salts of four members take every path of the skewed case.
    assert tried(df.withColumns({"c": F.lit("x"), "slice": F.lit(1)}), slice_rows=3, members=4) == plain_trie(rows)


def test_turns_are_numbered_across_ranges(spark):
    rows = [(c, t, "user", f"{c} {t % 3}") for c in (1, 2) for t in range(300)] + [(2, None, "user", "first")]
    found = prefix_trie.numbered(spark.createDataFrame(rows, TURNS)).join(
        prefix_trie._families(prefix_trie.numbered(spark.createDataFrame(rows, TURNS)), F.lit(0).cast("long")).select("c", "part", "start"), ["c", "part"]
    )
    places = sorted((r.c, r.p + r.start) for r in found.collect())
    assert places == [(c, p) for c, n in ((1, 300), (2, 301)) for p in range(1, n + 1)]


def test_trie_of_an_empty_table_and_of_one_hot_node(spark):
    assert tried(spark.createDataFrame([], TURNS)) == []
    rows = [(c, 0, "system", "the same prompt") for c in range(0, 4000, 5)] + [(c, 1, "user", f"{c % 7}") for c in range(0, 4000, 5)]
    assert tried(spark.createDataFrame(rows, TURNS), members=50) == plain_trie(rows)


# ---------------------------------------------------------------- sketches


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:], strict=False)) or frozenset((x,) for x in w))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    best = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        best[find(k)].append((i is None, i or 0))
    least = {k: (None if min(v)[0] else min(v)[1]) for k, v in best.items()}
    return sorted(((i, len(sets[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def sketched(df):
    return sorted(map(tuple, minhash_dedup.decide(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def texts(seed=5):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    rows, k = [], 0
    for length in (1, 2, 3, 5, 12, 40, 51, 52, 60, 64, 66, 80, 150, 400):
        base = [word() for _ in range(length)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + length // 9)):
                copy[rng.randrange(length)] = word()
            rows.append((k, " ".join(copy)))
            k += 1
    return rows


def test_components_equal_the_plain_version(spark):
    rows = texts()
    rows += [(900, None), (901, ""), (902, " \t"), (903, "One"), (904, "one"), (905, "É one"), (906, "é one")]
    rows += [(None, "same words in here"), (None, "of nobody at all"), (5, rows[5][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sketched(df) == plain_components(rows)
    assert sketched(df.withColumns({"sid": F.lit(1), "n": F.lit("x"), "set": F.lit(2), "salt": F.lit(3)})) == plain_components(rows)


def test_a_large_group_of_near_copies_and_a_chain(spark):
    rng = random.Random(9)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for k in range(250):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(90)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    # A chain whose ends share nothing.
    rows += [(1000 + k, " ".join(f"c{w}" for w in range(k * 9, k * 9 + 100))) for k in range(30)]
    # Many share a passage but are no copies: half of each is its own.
    rows += [(2000 + k, " ".join([*base[:45], *(f"o{k}_{w}" for w in range(45))])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sketched(df) == plain_components(rows)


def test_blocks_of_a_list_pair_all_of_different_roots(spark):
    rows = [(1, k, 10 + k % 3) for k in range(60)] + [(2, k, 100) for k in range(5)]
    roots = spark.createDataFrame([(k, k // 20) for k in range(60)], "sid long, root long")
    lists = spark.createDataFrame(rows, "v long, sid long, n long")
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if a // 20 != b // 20 and 5 * min(10 + a % 3, 10 + b % 3) >= 4 * max(10 + a % 3, 10 + b % 3)}
    for block in (7, 2048):
        assert {tuple(r) for r in minhash_dedup.crossings(lists, roots, 60, block).collect()} == want


def _classes(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df, minhash_dedup.classes(minhash_dedup.sets(df))


def test_one_common_pair_of_words_makes_no_list(spark):
    rows = [(k, " ".join([*(f"a{k}_{w}" for w in range(9)), "in", "the", *(f"z{k}_{w}" for w in range(9))])) for k in range(60)]
    _, each = _classes(spark, rows)
    assert minhash_dedup.inverted(each).count() == 0


def test_classes_that_meet_by_chance_stay_in_no_list(spark):
    shared = [f"s{w}" for w in range(14)]
    rows = [(k, " ".join([*shared, *(f"o{k}_{w}" for w in range(60))])) for k in range(40)]
    rows += [(100 + k, " ".join([*(f"c{w}" for w in range(80)), *shared[: 10 - k]])) for k in range(2)]
    _, each = _classes(spark, rows)
    ids = dict(map(tuple, each.select("sid", "best.doc_id").collect()))
    assert {ids[r.sid] for r in minhash_dedup.inverted(each).collect()} == {100, 101}


def _marked(rng, lists):
    """Rows (v, sid, n, sketch) of lists whose members are copies of a text of theirs, or their own."""
    rows, sid = [], 0
    for v, size in enumerate(lists):
        base = rng.sample(range(10**15), 90)
        for _ in range(size):
            n = rng.choice((20, 60, 64, 80, 90))
            own = rng.sample(range(10**15), n)
            values = sorted(base[: n - n // 10] + own[: n // 10] if rng.random() < 0.2 else own)
            rows.append((v, sid, n, values))
            sid += 1
    return sorted(rows, key=lambda r: (r[0], r[2]))


def test_sifted_lists_lose_no_pair_that_sketches_let_pass(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rows = _marked(random.Random(3), [1, 2, 5, 8, 9, 40, 150, 700, 3])
    classes = pa.RecordBatch.from_pylist([{"sid": s, "n": n, "sketch": x[:64]} for _, s, n, x in rows])
    marks = next(minhash_dedup._mark_batches([classes]))
    table = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(3)] + marks.columns[1:], ["v", "sid", "n", *marks.schema.names[1:]])
    arrays = [np.array(x[:64]) for *_, x in rows]
    need = set()
    for a, (v, s, n, _) in enumerate(rows):
        for b in range(a):
            if rows[b][0] == v and 5 * min(n, rows[b][2]) >= 4 * max(n, rows[b][2]) and minhash_dedup.promising(arrays[a], n, arrays[b], rows[b][2]):
                need |= {s, rows[b][1]}
    for limit in (16_384, 300):
        monkeypatch.setattr(minhash_dedup, "SIFTED", limit)
        for step in (50, 10_000):
            got = [s for x in minhash_dedup._sift_batches(table.slice(k, step) for k in range(0, len(rows), step)) for s in x.column("sid").to_pylist()]
            assert len(got) == len(set(got)) and need <= set(got)
            long = {s for v, s, *_ in rows if v == 7}
            assert len(set(got) - need - (long if limit == 300 else set())) <= 2
            assert limit != 300 or long <= set(got)


def test_crowded_lists_return_members_and_join_the_same_roots(spark):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randrange(5, 12)):
            copy[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    df, each = _classes(spark, rows)
    roots = spark.createDataFrame([], "sid long, root long")
    long = minhash_dedup.inverted(each).where("m > 8")
    ids = dict(map(tuple, each.select("sid", "best.doc_id").collect()))
    want = {(i, n, c) for i, n, c, _ in plain_components(rows)}
    for dense in (0, 10**6):
        links = minhash_dedup.across(long, roots, each, df, 60, 16, dense)
        if dense == 0:
            assert links.count() < 33 * 60
        found = {i: i for i in range(60)}
        pairs = [(ids[r.a], ids[r.b]) for r in links.collect()]
        for _ in range(60):
            for a, b in pairs:
                found[a] = found[b] = min(found[a], found[b])
        assert {(i, c) for i, c in found.items()} == {(i, c) for i, _, c in want}


def test_no_documents(spark):
    assert sketched(spark.createDataFrame([], "doc_id long, text string")) == []
    assert sketched(spark.createDataFrame([(3, ""), (4, None)], "doc_id long, text string")) == [(3, 0, 3, True), (4, 0, 4, True)]
