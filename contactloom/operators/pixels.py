"""Bins and sparse contact maps: pixels (i, j, v)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bins_of(chromosomes: DataFrame, resolution: int) -> DataFrame:
    """(bin, chrom, idx, start, end) from (chrom, ord, length): length // resolution + 1 bins each, numbered along the genome.

    The table of chromosomes is small by nature; bins are made by explode.
    """
    from pyspark.sql import Window

    n = F.floor(F.col("length") / resolution).cast("long") + 1
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    sections = chromosomes.withColumn("n", n).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return sections.select("chrom", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("idx")).select(
        (F.col("first") + F.col("idx")).alias("bin"),
        "chrom",
        "idx",
        (F.col("idx") * resolution).alias("start"),
        ((F.col("idx") + 1) * resolution).alias("end"),
    )


def half_pixels(pairs: DataFrame, bin1: Column, bin2: Column) -> DataFrame:
    """Upper triangle from pairs: each pair counts once, i <= j.

    The bins come out of a generator, which filters on i or j do not pass: pushed below, they would repeat the bins'
    expressions until the compiler gave up on the method, which then ran interpreted.
    """
    binned = pairs.select(F.inline(F.array(F.struct(bin1.alias("a"), bin2.alias("b")))))
    return (
        binned.select(F.least("a", "b").cast("long").alias("i"), F.greatest("a", "b").cast("long").alias("j"))
        .groupBy("i", "j")
        .agg(F.count("*").alias("v"))
    )


def symmetric(half: DataFrame, double_diagonal: bool = True) -> DataFrame:
    """Both triangles of a half map.  Every pair adds to (i, j) and (j, i), so the diagonal doubles.

    The mirror image is made after the aggregation, which shuffles each cell once.
    """
    diagonal = F.array(F.struct("i", "j", (F.col("v") * (2 if double_diagonal else 1)).alias("v")))
    both = F.array(F.struct("i", "j", "v"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return half.select(F.explode(F.when(F.col("i") == F.col("j"), diagonal).otherwise(both)).alias("c")).select("c.*")


def symmetrize(cells: DataFrame) -> DataFrame:
    """Sum of a map and its transpose, the diagonal once."""
    mirror = cells.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return cells.unionByName(mirror).groupBy("i", "j").agg(F.sum("v").alias("v"))


def upper(cells: DataFrame) -> DataFrame:
    return cells.where("i <= j")


def total(cells: DataFrame, bad: DataFrame | None = None, bias: DataFrame | None = None) -> DataFrame:
    """One row ``total``: the sum of the map, without bad bins, divided by the bias if given."""
    cells = good(cells, bad) if bad is not None else cells
    v = F.col("v")
    if bias is not None:
        cells, v = with_bias(cells, bias), F.col("v") / F.col("bi") / F.col("bj")
    return cells.agg(F.sum(v).alias("total"))


def good(cells: DataFrame, bad: DataFrame) -> DataFrame:
    """Cells without bad bins (column bin)."""
    for side in ("i", "j"):
        cells = cells.join(bad.select(F.col("bin").alias(side)), side, "left_anti")
    return cells.select("i", "j", *[c for c in cells.columns if c not in ("i", "j")])


def with_bias(cells: DataFrame, bias: DataFrame) -> DataFrame:
    """Cells with the biases bi and bj; cells of bins without a bias are left out."""
    for side in ("i", "j"):
        cells = cells.join(bias.select(F.col("bin").alias(side), F.col("b").alias(f"b{side}")), side)
    return cells.select("i", "j", *[c for c in cells.columns if c not in ("i", "j")])


def normalized(cells: DataFrame, bias: DataFrame) -> DataFrame:
    return with_bias(cells, bias).select("i", "j", (F.col("v") / F.col("bi") / F.col("bj")).alias("v"))


def decayed(cells: DataFrame, bias: DataFrame, bins: DataFrame, decay: DataFrame) -> DataFrame:
    """Cis cells divided by the biases and by the expected value of their distance (chrom, dist, expected)."""
    where = lambda side: bins.select(F.col("bin").alias(side), F.col("chrom").alias(f"c{side}"))
    cis = with_bias(cells, bias).join(where("i"), "i").join(where("j"), "j").where("ci = cj")
    return (
        cis.withColumn("dist", F.abs(F.col("i") - F.col("j")))
        .join(decay.withColumnRenamed("chrom", "ci"), ["ci", "dist"])
        .select("i", "j", F.try_divide(F.col("v") / F.col("bi") / F.col("bj"), "expected").alias("v"))
    )


def rebin(cells: DataFrame, factor: int) -> DataFrame:
    """Blocks of ``factor`` x ``factor`` cells summed; the total is kept."""
    if factor < 1 or factor != int(factor):
        raise ValueError("only integer multiples of the resolution")
    block = lambda c: F.floor(F.col(c) / int(factor)).cast("long").alias(c)
    return cells.select(block("i"), block("j"), "v").groupBy("i", "j").agg(F.sum("v").alias("v"))


def add(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cell-wise sum."""
    return first.select("i", "j", "v").unionByName(second.select("i", "j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))


def divide(first: DataFrame, second: DataFrame) -> DataFrame:
    """Cell-wise ratio; null where the second has no value, 0 where the first has none."""
    a, b = first.select("i", "j", F.col("v").alias("a")), second.select("i", "j", F.col("v").alias("b"))
    return a.join(b, ["i", "j"], "full").select(
        "i", "j", F.try_divide(F.coalesce("a", F.lit(0)).cast("double"), F.col("b").cast("double")).alias("v")
    )


_REGION = re.compile(r"^(?P<chrom>[^:]+)(?::(?P<a>\d+)-(?P<b>\d+))?$")


def focus(region: str | tuple, sections: dict[str, tuple[int, int]], resolution: int) -> tuple[int, int, int, int]:
    """Half-open bin ranges (lo1, hi1, lo2, hi2) of a region.

    Regions: (start, end) in bins, 1-based and inclusive; a four-tuple of both axes;
    a chromosome; ``chrom:a-b`` in nucleotides (end exclusive); or two such regions.
    ``sections``: chromosome -> (first bin, end bin).
    """

    def one(text: str) -> tuple[int, int]:
        m = _REGION.match(text)
        if m is None or m["chrom"] not in sections:
            raise ValueError(f"unknown region {text!r}")
        first, end = sections[m["chrom"]]
        if m["a"] is None:
            return first, end
        lo, hi = first + int(m["a"]) // resolution, first + int(m["b"]) // resolution
        if not first <= lo <= hi <= end:
            raise ValueError(f"region {text!r} is outside its chromosome")
        return lo, hi

    if isinstance(region, str):
        return one(region) * 2
    if len(region) == 2 and all(isinstance(x, str) for x in region):
        return one(region[0]) + one(region[1])
    if len(region) == 2:
        return (region[0] - 1, region[1]) * 2
    if len(region) == 4:
        return region[0] - 1, region[1], region[2] - 1, region[3]
    raise ValueError(f"unknown region {region!r}")


def crop(cells: DataFrame, ranges: tuple[int, int, int, int], diagonal: bool = True, shift: bool = True) -> DataFrame:
    """Cells of a region; indices relative to its start with ``shift``.  The ranges reach the scan as pushed filters."""
    lo1, hi1, lo2, hi2 = ranges
    kept = cells.where((F.col("i") >= lo1) & (F.col("i") < hi1) & (F.col("j") >= lo2) & (F.col("j") < hi2))
    if not diagonal:
        kept = kept.where("i <> j")
    if not shift:
        return kept
    return kept.withColumns({"i": F.col("i") - lo1, "j": F.col("j") - lo2})


def dense_rows(spark: SparkSession, cells: DataFrame, n: int) -> DataFrame:
    """(i, row) with the whole row of ``n`` values: zeros where there is no cell."""
    filled = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", F.col("v").cast("double")))).alias("m"))
    row = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda j: F.coalesce(F.col("m")[j], F.lit(0.0)))
    every = spark.range(n).withColumnRenamed("id", "i")
    return every.join(filled, "i", "left").select("i", F.coalesce(row, F.array_repeat(F.lit(0.0), n)).alias("row"))


def zscores(cells: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """z-scores of log10 of the upper triangle without zeros (population deviation), by the mean and deviation of all cells ``among``."""
    upper_logs = lambda df: df.where("i <= j AND v > 0").withColumn("l", F.log10("v"))
    logs = upper_logs(cells)
    stats = upper_logs(cells if among is None else among).agg(F.avg("l").alias("m"), F.stddev_pop("l").alias("s"))
    return logs.crossJoin(F.broadcast(stats)).select("i", "j", F.try_divide(F.col("l") - F.col("m"), F.col("s")).alias("z"))


def interaction_pairs(cells: DataFrame, cutoff: float | None = None, diagonal: bool = False, uniq: bool = True) -> DataFrame:
    """(i, j, v) triples above a cutoff."""
    kept = cells if diagonal else cells.where("i <> j")
    kept = kept.where("i <= j") if uniq else kept
    return kept if cutoff is None else kept.where(F.col("v") > cutoff)


def bias_region(bias: DataFrame, lo: int, hi: int) -> DataFrame:
    """Biases of the bins lo .. hi - 1, numbered from 0."""
    return bias.where((F.col("bin") >= lo) & (F.col("bin") < hi)).withColumn("bin", F.col("bin") - lo)


def region_name(chrom1: str, start1: int | None = None, end1: int | None = None, *other) -> str:
    """File-name part of one or two regions."""
    part = lambda c, a, b: c if a is None else f"{c}:{a}-{b}"
    second = (part(*other) if len(other) == 3 else other[0]) if other else None
    return part(chrom1, start1, end1) + (f"_{second}" if second else "")


def binary_contacts(cells: DataFrame) -> DataFrame:
    """(i, j) of the upper-triangle cells above the median value."""
    upper_ = cells.where("i < j")
    middle = upper_.agg(F.median("v").alias("m"))
    return upper_.crossJoin(F.broadcast(middle)).where(F.col("v") > F.col("m")).select("i", "j")


def randomized(cells: DataFrame, bins: DataFrame, seed: int = 1) -> DataFrame:
    """Cis values of the upper triangle shuffled within their chromosome's diagonal: each value moves to another cell of it."""
    from pyspark.sql import Window

    chrom = lambda s: bins.select(F.col("bin").alias(s), F.col("chrom").alias(f"c{s}"))
    cis = cells.where("i <= j").join(chrom("i"), "i").join(chrom("j"), "j").where("ci = cj").withColumn("dist", F.col("j") - F.col("i"))
    place = Window.partitionBy("ci", "dist")
    rows = cis.withColumns({"at": F.row_number().over(place.orderBy("i")), "to": F.row_number().over(place.orderBy(F.xxhash64("i", "j", F.lit(seed)), "i"))})
    values = rows.select("ci", "dist", F.col("to").alias("at"), F.col("v").alias("w"))
    return rows.select("ci", "dist", "at", "i", "j").join(values, ["ci", "dist", "at"]).select("i", "j", F.col("w").alias("v"))
