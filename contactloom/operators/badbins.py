"""Bad bins: tables (bin, why)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators.pixels import symmetric


def coverage(cells: DataFrame) -> DataFrame:
    """(bin, cells, total) of a symmetric map: non-zero cells and sum of each row."""
    return cells.where("v <> 0").groupBy(F.col("i").alias("bin")).agg(F.count("*").alias("cells"), F.sum("v").alias("total"))


def by_zero_count(cells: DataFrame, bins: DataFrame, n_bins: int, perc_zero: float = 99, min_count: float | None = None, doubled: bool = True) -> DataFrame:
    """Bins with more than perc_zero % empty cells or, if given, a sum below ``min_count`` (twice that in a doubled map)."""
    rows = bins.select("bin").join(coverage(cells), "bin", "left").fillna(0, ["cells", "total"])
    empty = n_bins - F.col("cells") > int(n_bins * perc_zero / 100)
    low = F.col("total") < (min_count or 0) * (2 if doubled else 1)
    bad = F.when(empty, "zeros").when(low, "low count")
    return rows.select("bin", bad.alias("why")).where("why IS NOT NULL")


def by_min_count(cells: DataFrame, bins: DataFrame, min_count: float) -> DataFrame:
    """Bins whose row sum is below ``min_count``."""
    rows = bins.select("bin").join(coverage(cells), "bin", "left")
    return rows.where(F.coalesce("total", F.lit(0)) < min_count).select("bin", F.lit("low count").alias("why"))


def local_counts(half: DataFrame, bins: DataFrame, near: int = 1, mid: int | None = None) -> DataFrame:
    """(bin, cis, total, near, mid) from a half map: cis sums within ``near`` bins and between there and ``mid``."""
    chrom = lambda side: bins.select(F.col("bin").alias(side), F.col("chrom").alias(f"c{side}"))
    rows = symmetric(half).join(chrom("i"), "i").join(chrom("j"), "j")
    cis, dist = F.col("ci") == F.col("cj"), F.abs(F.col("i") - F.col("j"))
    upto = F.lit(True) if mid is None else dist <= mid
    keep = lambda c: F.sum(F.when(c, F.col("v")).otherwise(0))
    return rows.groupBy(F.col("i").alias("bin")).agg(
        keep(cis).alias("cis"), F.sum("v").alias("total"), keep(cis & (dist <= near)).alias("near"), keep(cis & (dist > near) & upto).alias("mid")
    )


def by_local_ratio(counts: DataFrame, min_ratio: float = 1.0, min_count: float | None = None) -> DataFrame:
    """Bins with near / mid below ``min_ratio`` or near below ``min_count``; by default the 95th percentile of near among low ratios."""
    ratio = F.coalesce(F.try_divide(F.col("near").cast("double"), F.col("mid").cast("double")), F.lit(0.0))
    rated = counts.withColumn("ratio", ratio)
    if min_count is None:
        limit = rated.where((F.col("ratio") < min_ratio) & (F.col("near") >= 1)).agg(F.coalesce(F.percentile("near", F.lit(0.95)), F.lit(0.0)).alias("limit"))
        rated = rated.crossJoin(F.broadcast(limit))
    else:
        rated = rated.withColumn("limit", F.lit(float(min_count)))
    return rated.where((F.col("ratio") < min_ratio) | (F.col("near") < F.col("limit"))).select("bin", F.lit("local ratio").alias("why"))


def cis_share(counts: DataFrame) -> DataFrame:
    """(bin, share) of cis contacts in each bin."""
    return counts.select("bin", F.try_divide(F.col("cis").cast("double"), F.col("total").cast("double")).alias("share"))


def by_cis_share(counts: DataFrame, n_bins: int, low: float = 0.3, high: float = 0.8, sigma: float = 2.0, min_perc: float | None = None, max_perc: float | None = None) -> DataFrame:
    """Bins whose depth lies outside the range in which the cis share behaves as between the depth quantiles ``low`` and ``high``.

    ``counts`` (bin, cis, total).  The shares, one number a bin in the order of depth, go to
    the driver, where the limits are found: bins do not grow with the reads.  Bins without
    contacts are below the range.
    """
    from contactloom.functions.maths import depth_limits

    rows = counts.where("total > 0").select("bin", "cis", "total").toPandas().sort_values(["total", "bin"])
    total = rows["total"].to_numpy(dtype=float)
    left, right = depth_limits((rows["cis"] / rows["total"]).to_numpy(dtype=float), n_bins, low, high, sigma, min_perc, max_perc)
    least, most = total[min(left, len(total) - 1)], total[right] if right < len(total) else total[-1] + 1
    every = counts.sparkSession.range(n_bins).withColumnRenamed("id", "bin").join(counts.select("bin", "total"), "bin", "left").fillna(0, ["total"])
    return every.where((F.col("total") < float(least)) | (F.col("total") > float(most))).select("bin", F.lit("cis share").alias("why"))


def for_modelling(cells: DataFrame, bins: DataFrame, n_bins: int, perc_zero: float = 90, min_count: float | None = None, auto: bool = True, diagonal: bool = True) -> DataFrame:
    """Bins that models leave out: empty or low ones, ones of a low mean, and ones without contacts on the diagonal or with an unknown value."""
    parts = [by_zero_count(cells, bins, n_bins, perc_zero, min_count, doubled=False)]
    if auto:
        parts.append(by_mean(cells, bins))
    if diagonal:
        on = cells.where("i = j AND v <> 0").select(F.col("i").alias("bin"))
        parts.append(bins.select("bin").join(on, "bin", "left_anti").select("bin", F.lit("empty diagonal").alias("why")))
    unknown = cells.where(F.isnan(F.col("v").cast("double"))).select(F.col("i").alias("bin")).distinct()
    parts.append(unknown.select("bin", F.lit("unknown value").alias("why")))
    return union(*parts)


def by_mean(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """Bins whose row sum lies below the first dip of the histogram of the row sums.

    The sums, one number a bin, go to the driver: bins do not grow with the reads.
    """
    from contactloom.functions.maths import low_root

    rows = coverage(cells)
    totals = rows.select(F.col("total").cast("double").alias("total")).toArrow()["total"].to_numpy()
    return rows.where(F.col("total") < low_root(totals)).select("bin", F.lit("low mean").alias("why"))


def union(*parts: DataFrame) -> DataFrame:
    """All bad bins with their first reason."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("bin").agg(F.min("why").alias("why"))


def runs(bad: DataFrame, bins: DataFrame) -> DataFrame:
    """(chrom, first, last, n): runs of neighbouring bad bins."""
    from pyspark.sql import Window

    rows = bad.join(bins.select("bin", "chrom", "idx"), "bin")
    island = F.col("idx") - F.row_number().over(Window.partitionBy("chrom").orderBy("idx"))
    return rows.withColumn("g", island).groupBy("chrom", "g").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).drop("g")
