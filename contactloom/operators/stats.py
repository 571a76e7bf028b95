"""Descriptive statistics of pairs and maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cis_trans_ratio(cells: DataFrame, bins: DataFrame, exclude: tuple = (), diagonal: bool = True, equals=None) -> DataFrame:
    """One row ``ratio``: the share of the map within chromosomes.  ``equals(a, b)`` is a column predicate."""
    chrom = lambda side: bins.select(F.col("bin").alias(side), F.col("chrom").alias(f"c{side}"))
    rows = cells.join(chrom("i"), "i").join(chrom("j"), "j")
    if exclude:
        rows = rows.where(~F.col("ci").isin(*exclude) & ~F.col("cj").isin(*exclude))
    if not diagonal:
        rows = rows.where("i <> j")
    same = (equals or (lambda a, b: a == b))(F.col("ci"), F.col("cj"))
    return rows.agg(F.try_divide(F.sum(F.when(same, F.col("v")).otherwise(0)).cast("double"), F.sum("v").cast("double")).alias("ratio"))


def distance_curve(half: DataFrame, bins: DataFrame, min_dist: int = 1, max_dist: int = 1000) -> DataFrame:
    """(dist, total, cells, mean): contacts per cis distance over all cells of that distance."""
    chrom = lambda side: bins.select(F.col("bin").alias(side), F.col("chrom").alias(f"c{side}"))
    cis = half.join(chrom("i"), "i").join(chrom("j"), "j").where("ci = cj").withColumn("dist", F.col("j") - F.col("i"))
    sums = cis.where(F.col("dist").between(min_dist, max_dist)).groupBy("dist").agg(F.sum("v").alias("total"))
    size = bins.groupBy("chrom").agg(F.count("*").alias("size"))
    cells = size.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("dist"), "size")
    cells = cells.groupBy("dist").agg(F.sum(F.col("size") - F.col("dist")).alias("cells"))
    return sums.join(cells, "dist").select("dist", "total", "cells", (F.col("total") / F.col("cells")).alias("mean"))


def log_slope(curve: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """One row slope, intercept, r2 of log(mean) on log(dist) for distances in (low, high]."""
    rows = curve.where((F.col("dist") > low) & (F.col("mean") > 0))
    rows = rows if high is None else rows.where(F.col("dist") <= high)
    x, y = F.ln("dist"), F.ln("mean")
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def genomic_distribution(pairs: DataFrame, resolution: int = 10_000) -> DataFrame:
    """(chrom, bin, n): read ends per bin."""
    ends = pairs.select(F.explode(F.array(*[F.struct(F.col(f"c{k}").alias("c"), F.col(f"p{k}").alias("p")) for k in (1, 2)])).alias("e"))
    return ends.groupBy(F.col("e.c").alias("chrom"), F.floor(F.col("e.p") / resolution).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def strand_bias(pairs: DataFrame, step: int, length: int) -> DataFrame:
    """(dist, n, same+, same-, facing, away): shares of the four strand pairs of cis pairs per distance step."""
    d = F.abs(F.col("p2") - F.col("p1"))
    cis = pairs.where((F.col("c1") == F.col("c2")) & (d < length)).withColumn("dist", F.floor(d / step).cast("long"))
    first = F.when(F.col("p1") <= F.col("p2"), F.col("s1")).otherwise(F.col("s2"))
    second = F.when(F.col("p1") <= F.col("p2"), F.col("s2")).otherwise(F.col("s1"))
    share = lambda a, b: F.avg(F.when((first == a) & (second == b), 1.0).otherwise(0.0))
    return cis.groupBy("dist").agg(
        F.count("*").alias("n"), share(1, 1).alias("plus"), share(0, 0).alias("minus"), share(1, 0).alias("facing"), share(0, 1).alias("away")
    )


def insert_sizes(pairs: DataFrame, too_large: int = 10_000) -> DataFrame:
    """(size, n) of facing pairs inside one fragment: dangling ends."""
    size = F.abs(F.col("p2") - F.col("p1"))
    facing = (F.col("s1") != F.col("s2")) & ((F.col("p2") > F.col("p1")).cast("int") != F.col("s2"))
    same = (F.col("c1") == F.col("c2")) & (F.col("re1") == F.col("re2"))
    return pairs.where(same & facing & (size <= too_large)).groupBy(size.alias("size")).agg(F.count("*").alias("n"))


def insert_size_stats(pairs: DataFrame, max_percent: float = 99.9, too_large: int = 10_000) -> DataFrame:
    """One row n, mean, median, mad, perc_max of the insert sizes."""
    sizes = insert_sizes(pairs, too_large)
    mid = sizes.agg(F.expr("percentile(size, 0.5, n)").alias("median"))
    return sizes.crossJoin(F.broadcast(mid)).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"),
        F.first("median").alias("median"),
        F.expr("percentile(abs(size - median), 0.5, n)").alias("mad"),
        F.expr(f"percentile(size, {max_percent / 100}, n)").alias("perc_max"),
    )


fragment_size = insert_size_stats


def molecule_lengths(pairs: DataFrame, window: int = 20, longest: int = 800) -> DataFrame:
    """(size, n, smooth): histogram of facing pairs' lengths with a moving average."""
    sizes = insert_sizes(pairs, longest)
    every = sizes.sparkSession.range(longest + 1).withColumnRenamed("id", "size").join(sizes, "size", "left").fillna(0, ["n"])
    return every.withColumn("smooth", moving_average(F.col("n"), "size", window))


def moving_average(value: Column, order: str, n: int = 3) -> Column:
    """Mean of a row and the n - 1 before it."""
    return F.avg(value).over(Window.orderBy(order).rowsBetween(-(n - 1), 0))


def site_distances(pairs: DataFrame, longest: int = 1000) -> DataFrame:
    """(dist, n): distance of facing ends to the nearest cut site of their fragment."""
    ends = pairs.where("s1 <> s2").select(
        F.explode(F.array(*[F.least(F.col(f"p{k}") - F.col(f"rs{k}"), F.col(f"re{k}") - F.col(f"p{k}")) for k in (1, 2)])).alias("dist")
    )
    return ends.where(F.col("dist") <= longest).groupBy("dist").agg(F.count("*").alias("n"))


def cumulative_mapped(counts: DataFrame) -> DataFrame:
    """(side, window, n, upto): reads mapped up to each window of (side, window, n)."""
    upto = Window.partitionBy("side").orderBy("window").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("upto", F.sum("n").over(upto))


def interval_means(intervals: DataFrame, resolution: int) -> DataFrame:
    """(chrom, bin, value): overlap-weighted sum of (chrom, start, end, value) per bin, divided by the resolution.

    Each interval is exploded to the bins it overlaps, so no range join is needed.
    """
    first, last = F.floor(F.col("start") / resolution), F.floor((F.col("end") - 1) / resolution)
    rows = intervals.where("end > start").select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("bin"))
    overlap = F.least("end", (F.col("bin") + 1) * resolution) - F.greatest("start", F.col("bin") * resolution)
    return rows.groupBy("chrom", "bin").agg((F.sum(overlap * F.col("value")) / resolution).alias("value"))


def base_content(genome: DataFrame, resolution: int) -> DataFrame:
    """(chrom, bin, gc): share of G and C among the known bases of each bin of (chrom, seq)."""
    n = F.floor((F.length("seq") - 1) / resolution).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n), lambda b: F.upper(F.substr("seq", b * resolution + 1, F.lit(resolution))))
    # Only the pieces leave the row, each once: the sequence itself is not copied to every bin.
    part = genome.where(F.length("seq") > 0).select("chrom", F.posexplode(pieces).alias("bin", "s")).withColumn("bin", F.col("bin").cast("long"))
    known = F.length(F.regexp_replace("s", "[^ACGT]", ""))
    return part.select("chrom", "bin", F.try_divide(F.length(F.regexp_replace("s", "[^GC]", "")).cast("double"), known.cast("double")).alias("gc"))


def read_quality(reads: DataFrame, sites: dict[str, str] | None = None) -> DataFrame:
    """(pos, n, mean, sd, unknown) of the Phred scores per position of (seq, qual)."""
    each = reads.select(F.posexplode(F.arrays_zip(F.split("qual", "").alias("q"), F.split("seq", "").alias("b"))).alias("pos", "x")).where("x.q <> ''")
    score = F.ascii(F.col("x.q")) - 33
    return each.groupBy("pos").agg(
        F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.count_if(F.col("x.b") == "N").alias("unknown")
    )


def site_counts(reads: DataFrame, sites: dict[str, str]) -> DataFrame:
    """One row with the number of reads that hold each named motif."""
    return reads.agg(F.count("*").alias("reads"), *[F.count_if(F.col("seq").contains(m)).alias(k) for k, m in sites.items()])


#: Items whose clusters are sent to every task; those of more are joined to the pairs.
SENT = 1_000_000


def cluster_quality(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row ``ch``: ratio of the mean between-cluster to the mean within-cluster pair distances, per degree of freedom.

    ``scores`` (a, b, d) with a < b; ``clusters`` (item, cluster).
    """
    n, k = clusters.count(), clusters.select("cluster").distinct().count()
    held = F.broadcast if n <= SENT else lambda df: df
    side = lambda s: held(clusters.select(F.col("item").alias(s), F.col("cluster").alias(f"k{s}")))
    rows = scores.join(side("a"), "a").join(side("b"), "b")
    within = F.avg(F.when(F.col("ka") == F.col("kb"), F.col("d")))
    between = F.avg(F.when(F.col("ka") != F.col("kb"), F.col("d")))
    return rows.agg(F.try_divide(between * (n - k), within * max(k - 1, 1)).alias("ch"))


def mad(value: str, df: DataFrame) -> DataFrame:
    """One row ``mad``: the median absolute deviation of a column."""
    mid = df.agg(F.median(value).alias("m"))
    return df.crossJoin(F.broadcast(mid)).agg(F.median(F.abs(F.col(value) - F.col("m"))).alias("mad"))


def right_double_mad(value: str, df: DataFrame) -> DataFrame:
    """The same over values at or above the median."""
    mid = df.agg(F.median(value).alias("m"))
    return df.crossJoin(F.broadcast(mid)).where(F.col(value) >= F.col("m")).agg(F.median(F.abs(F.col(value) - F.col("m"))).alias("mad"))
