"""Read pairs: orientation, intersection, classes, duplicates and filters.

A pair has ``read_id, c1, p1, s1, l1, rs1, re1, c2, p2, s2, l2, rs2, re2``: chromosome,
position, strand (1 or 0), length and restriction fragment of both ends.  The class
of a pair is a bit mask, filter k being bit 2^(k-1); classes are not exclusive.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.normalize import checkpointed

#: Filters 1 to 10 and the mark of pairs between chromosomes.
FILTERS = {
    1: "self-circle",
    2: "dangling-end",
    3: "error",
    4: "extra dangling-end",
    5: "too close from RES",
    6: "too short",
    7: "too large",
    8: "over-represented",
    9: "duplicated",
    10: "random breaks",
    11: "trans-chromosomic",
}
#: Filters that a region query leaves out by default.
DEFAULT_EXCLUDE = (1, 2, 3, 4, 6, 7, 8, 9, 10)
END = ["c", "p", "s", "l", "rs", "re"]
KEYS_LOOSE = ["c1", "p1", "c2", "p2", "s1", "s2"]
KEYS_STRICT = [*KEYS_LOOSE, "l1", "l2"]


def mask(filters: Iterable[int]) -> int:
    """Bit mask of filter numbers."""
    return sum(1 << (k - 1) for k in set(filters))


def base_name(read: Column) -> Column:
    """Read name without the fragment mark."""
    return F.split(read, "~").getItem(0)


def oriented(pairs: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """Pairs with the upstream end first; ``order`` (chrom, ord) ranks chromosomes, else they compare as they are."""
    if order is not None:
        for k in ("1", "2"):
            pairs = pairs.join(order.select(F.col("chrom").alias(f"c{k}"), F.col("ord").alias(f"__o{k}")), f"c{k}")
        swap = (F.col("__o1") > F.col("__o2")) | ((F.col("__o1") == F.col("__o2")) & (F.col("p1") > F.col("p2")))
    else:
        swap = (F.col("c1") > F.col("c2")) | ((F.col("c1") == F.col("c2")) & (F.col("p1") > F.col("p2")))
    ends = [
        F.when(swap, F.col(f"{n}{3 - k}")).otherwise(F.col(f"{n}{k}")).alias(f"{n}{k}") for k in (1, 2) for n in END
    ]
    rest = [c for c in pairs.columns if c not in {f"{n}{k}" for n in END for k in (1, 2)} | {"__o1", "__o2"}]
    return pairs.select(*rest, *ends)


def same_fragment_class(max_molecule_length: int = 500) -> Column:
    """Bits of filters 1 to 4."""
    cis = F.col("c1") == F.col("c2")
    same = cis & (F.col("re1") == F.col("re2"))
    outward = (F.col("p2") > F.col("p1")).cast("int") == F.col("s2")
    opposite = F.col("s1") != F.col("s2")
    near = F.abs(F.col("p1") - F.col("p2")) < max_molecule_length
    return (
        F.when(same & opposite & outward, 1)
        .when(same & opposite, 2)
        .when(same, 4)
        .when(cis & near & opposite & ~outward, 8)
        .otherwise(0)
    )


def site_class(re_proximity: int = 5, min_dist_to_re: int = 750, min_frag_size: int = 100, max_frag_size: int = 100_000) -> Column:
    """Bits of filters 5, 6, 7 and 10: distances to restriction sites and fragment sizes."""
    d = {f"{k}{w}": F.col(f"re{k}") - F.col(f"p{k}") if w == 1 else F.col(f"p{k}") - F.col(f"rs{k}") for k in (1, 2) for w in (1, 2)}
    close = F.least(*d.values()) < re_proximity
    single = ~F.col("read_id").cast("string").contains("~")
    far = (F.least(d["11"], d["12"]) > min_dist_to_re) | (F.least(d["21"], d["22"]) > min_dist_to_re)
    sizes = [F.col(f"re{k}") - F.col(f"rs{k}") for k in (1, 2)]
    bit = lambda c, k: F.when(c, 1 << (k - 1)).otherwise(0)
    return (
        bit(close & single, 5)
        .bitwiseOR(bit(F.least(*sizes) < min_frag_size, 6))
        .bitwiseOR(bit(F.greatest(*sizes) > max_frag_size, 7))
        .bitwiseOR(bit(far, 10))
    )


def fragment_counts(pairs: DataFrame) -> DataFrame:
    """(c, rs, n): read ends per fragment.  One pass: both ends of a row are exploded after the projection."""
    ends = pairs.select(F.explode(F.array(*[F.struct(F.col(f"c{k}").alias("c"), F.col(f"rs{k}").alias("rs")) for k in (1, 2)])).alias("e"))
    return ends.groupBy("e.c", "e.rs").agg(F.count("*").alias("n"))


#: Over-represented fragments that are broadcast (about 24 bytes each).
MAX_BROADCAST = 500_000


def rank_cut(counts: DataFrame, share: float) -> DataFrame:
    """One row ``threshold``: the value at rank int((1 - share) * rows + 0.5) of the ascending counts.

    Ranks come from the histogram of the counts, so no task sorts all fragments.
    """
    histogram = counts.groupBy("n").agg(F.count("*").alias("k"))
    total = F.sum("k").over(Window.partitionBy())
    upto = F.sum("k").over(Window.orderBy("n"))
    at = F.floor(F.lit(1 - share) * total + 0.5)
    reached = F.when((upto >= at) & (at > 0), F.col("n")).when(at <= 0, None)
    return (
        histogram.select(reached.alias("r"), "n")
        .agg(F.coalesce(F.min("r"), F.max("n")).alias("threshold"))
    )


def over_represented_fragments(pairs: DataFrame, share: float = 0.005) -> DataFrame:
    """(c, rs, n) of fragments whose count exceeds the rank cut; at most ``share`` of all fragments."""
    counts = fragment_counts(pairs)
    return counts.join(rank_cut(counts, share), F.col("n") > F.col("threshold")).select("c", "rs", "n")


def duplicate_rank(strict: bool = False) -> Column:
    """Rank of a pair among those with equal ends, by read id."""
    return F.row_number().over(Window.partitionBy(*(KEYS_STRICT if strict else KEYS_LOOSE)).orderBy("read_id"))


def classify(
    pairs: DataFrame,
    max_molecule_length: int = 500,
    over_represented: float = 0.005,
    max_frag_size: int = 100_000,
    min_frag_size: int = 100,
    re_proximity: int = 5,
    min_dist_to_re: int = 750,
    strict_duplicates: bool = False,
) -> DataFrame:
    """Pairs with ``flag``: one projection, one rank and two lookups in the table of over-represented fragments.

    That table, at most ``over_represented`` of the fragments, is written and counted: up to
    ``MAX_BROADCAST`` rows it is broadcast, so that only the rank shuffles the pairs.
    """
    cut = checkpointed(over_represented_fragments(pairs, over_represented))
    small = cut.count() <= MAX_BROADCAST
    flagged = pairs
    for k in ("1", "2"):
        marks = cut.select(F.col("c").alias(f"c{k}"), F.col("rs").alias(f"rs{k}"), F.lit(True).alias(f"__over{k}"))
        flagged = flagged.join(F.broadcast(marks) if small else marks, [f"c{k}", f"rs{k}"], "left")
    own = same_fragment_class(max_molecule_length).bitwiseOR(site_class(re_proximity, min_dist_to_re, min_frag_size, max_frag_size))
    over = F.when(F.coalesce("__over1", "__over2", F.lit(False)), 1 << 7).otherwise(0)
    again = F.when(duplicate_rank(strict_duplicates) > 1, 1 << 8).otherwise(0)
    trans = F.when(F.col("c1") != F.col("c2"), 1 << 10).otherwise(0)
    flag = own.bitwiseOR(over).bitwiseOR(again).bitwiseOR(trans).cast("int")
    return flagged.withColumn("flag", flag).select(*pairs.columns, "flag")


def filter_counts(flagged: DataFrame) -> DataFrame:
    """(filter, n): pairs that carry each filter."""
    return (
        flagged.select(F.explode(F.array(*[F.when(F.col("flag").bitwiseAND(1 << (k - 1)) != 0, k) for k in FILTERS])).alias("filter"))
        .where("filter IS NOT NULL")
        .groupBy("filter")
        .agg(F.count("*").alias("n"))
    )


def apply_filter(flagged: DataFrame, exclude: Sequence[int] = DEFAULT_EXCLUDE, reverse: bool = False) -> DataFrame:
    """Pairs without any of the filters; with ``reverse`` those with one."""
    hit = F.col("flag").bitwiseAND(mask(exclude)) != 0
    return flagged.where(hit if reverse else ~hit)


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two pair tables; their columns must agree."""
    if set(first.columns) != set(second.columns):
        raise ValueError("the tables' columns differ")
    return first.unionByName(second)


#: The exclusive classes of a pair by its distances to cut sites.
SITE_CLASSES = {
    11: "dangling left",
    12: "dangling right",
    13: "rejoined",
    14: "self circle",
    15: "random break",
    16: "contact close",
    17: "contact far",
    18: "contact upstream",
    19: "contact downstream",
    20: "other",
}


def site_classes(pairs: DataFrame, max_length: int, left: Sequence[int] = range(-2, 4), right: Sequence[int] = range(0, 6)) -> DataFrame:
    """Pairs, oriented, with ``category`` 11 to 20 by strands and distances to the cut sites within ``max_length``.

    ``left`` and ``right`` are the offsets of dangling ends from the nearest site.  Where
    several classes fit, dangling goes before broken or rejoined, then circles, then contacts.
    """
    to_end = [F.col(f"re{k}") - F.col(f"p{k}") for k in (1, 2)]
    to_start = [F.col(f"p{k}") - F.col(f"rs{k}") for k in (1, 2)]
    nearest = [F.when(s < e, F.col(f"rs{k}")).otherwise(F.col(f"re{k}")) for k, s, e in zip((1, 2), to_start, to_end, strict=True)]
    forward = [F.col(f"s{k}") == 1 for k in (1, 2)]
    reverse = [F.col(f"s{k}") == 0 for k in (1, 2)]
    ahead = [f & (e < max_length) for f, e in zip(forward, to_end, strict=True)]
    behind = [r & (s < max_length) for r, s in zip(reverse, to_start, strict=True)]
    cis, gap = F.col("c1") == F.col("c2"), F.col("p2") - F.col("p1")
    contact = ~cis | ((nearest[0] != nearest[1]) & (F.col("re1") != F.col("re2")))
    short = cis & (gap < max_length) & forward[0] & reverse[1]
    category = (
        F.when(short & (F.col("p2") - nearest[1]).isin(list(right)), 12)
        .when(short & (F.col("p1") - nearest[0]).isin(list(left)), 11)
        .when(short & (F.col("re1") == F.col("re2")), 15)
        .when(short & (F.col("re1") <= F.col("rs2")), 13)
        .when((F.col("re1") == F.col("re2")) & behind[0] & ahead[1], 14)
        .when(contact & ahead[0] & ahead[1], 18)
        .when(contact & ahead[0] & behind[1] & (gap >= max_length), 17)
        .when(contact & behind[0] & ahead[1], 16)
        .when(contact & behind[0] & behind[1], 19)
        .otherwise(20)
    )
    return oriented(pairs).withColumn("category", category)


def intersect(ends1: DataFrame, ends2: DataFrame) -> DataFrame:
    """Pairs of the reads mapped on both sides.

    Ends are ``name, chrom, pos, strand, len, rs, re``, possibly several per read
    (multi-contacts).  The pieces of a read are merged per fragment; one fragment
    gives its outermost ends, n fragments give all their pairs, named ``#k/total``.
    """
    side = lambda df, k: df.select(base_name(F.col("name")).alias("read"), F.struct(F.lit(k).alias("side"), "pos", "chrom", "strand", "len", "rs", "re").alias("e"))
    both = side(ends1, 1).unionByName(side(ends2, 2)).groupBy("read").agg(
        F.sort_array(F.collect_list(F.struct("e.chrom", "e.rs", "e.re", "e.pos", "e.strand", "e.len", "e.side"))).alias("ends")
    )
    both = both.where("exists(ends, x -> x.side = 1) AND exists(ends, x -> x.side = 2)")
    fragments = F.expr("array_distinct(transform(ends, x -> struct(x.chrom AS chrom, x.rs AS rs, x.re AS re)))")
    both = both.withColumn("fragments", fragments)
    outer = F.expr("array(struct(ends[0] AS a, ends[size(ends) - 1] AS b))")
    # One end stands for a fragment: the longest piece, ties by position.
    best = F.expr(
        "transform(fragments, f -> array_max(transform(filter(ends, x -> x.chrom = f.chrom AND x.rs = f.rs AND x.re = f.re), "
        "x -> struct(x.len AS k, -x.pos AS q, x AS x))).x)"
    )
    pairs = F.expr("flatten(transform(best, (x, i) -> transform(slice(best, i + 2, size(best)), y -> struct(x AS a, y AS b))))")
    both = both.withColumn("best", best).withColumn("pairs", F.when(F.size("fragments") == 1, outer).otherwise(pairs))
    made = both.select("read", F.size("pairs").alias("total"), F.posexplode("pairs").alias("k", "p"))
    name = F.when(F.col("total") > 1, F.concat("read", F.lit("#"), F.col("k") + 1, F.lit("/"), "total")).otherwise(F.col("read"))
    columns = [
        F.col(f"p.{side}.{source}").alias(f"{target}{k}")
        for k, side in ((1, "a"), (2, "b"))
        for source, target in (("chrom", "c"), ("pos", "p"), ("strand", "s"), ("len", "l"), ("rs", "rs"), ("re", "re"))
    ]
    return oriented(made.select(name.alias("read_id"), *columns))


def flags_from_lists(pairs: DataFrame, lists: dict[int, DataFrame]) -> DataFrame:
    """Pairs with the flag of the read-id lists (column read_id) that name them, one list per filter."""
    from functools import reduce

    marks = [df.select("read_id", F.lit(1 << (k - 1)).alias("bit")) for k, df in lists.items()]
    if not marks:
        return pairs.withColumn("flag", F.lit(0))
    flags = reduce(DataFrame.unionByName, marks).groupBy("read_id").agg(F.bit_or("bit").alias("flag"))
    return pairs.join(flags, "read_id", "left").withColumn("flag", F.coalesce("flag", F.lit(0)))


def uniquely_mapped(hits: Column | None = None, mapq: Column | None = None, least: int = 4) -> Column:
    """Whether a read maps once: by its match string (``1`` first among the counts above zero) or its mapping quality."""
    if hits is not None:
        return hits.rlike(r"^(?:0:)*1(?:[:+].*)?$")
    return mapq >= least
