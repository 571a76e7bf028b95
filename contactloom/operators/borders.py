"""Alignment of borders between experiments, remapping between assemblies."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions.segmentation import progressive
from contactloom.shipping import ship


def nearest(first: DataFrame, second: DataFrame, max_dist: int) -> DataFrame:
    """(chrom, a, b, d): the nearest border of ``second`` for each of ``first`` within ``max_dist``; ties go to the lower.

    Borders (chrom, pos) are dealt to buckets of width max_dist, those of ``second``
    also to the two beside theirs.  In a bucket both are sorted by position, and the
    last border of ``second`` before and after is carried along: no pairs are made,
    however dense the borders are.
    """
    a = first.where("chrom IS NOT NULL AND pos IS NOT NULL").select("chrom", "pos", F.floor(F.col("pos") / max_dist).alias("k"), F.lit(True).alias("asks"))
    b = second.where("chrom IS NOT NULL AND pos IS NOT NULL").select("chrom", "pos", F.floor(F.col("pos") / max_dist).alias("h"))
    b = b.select("chrom", "pos", F.explode(F.array(F.col("h") - 1, F.col("h"), F.col("h") + 1)).alias("k"), F.lit(False).alias("asks"))
    bucket, given = Window.partitionBy("chrom", "k"), F.when(~F.col("asks"), F.col("pos"))
    # The default frame ends with the rows of equal position.
    rows = a.distinct().unionByName(b).withColumn("low", F.last(given, True).over(bucket.orderBy("pos")))
    rows = rows.withColumn("high", F.last(given, True).over(bucket.orderBy(F.desc("pos")))).where("asks")
    down, up = F.col("pos") - F.col("low"), F.col("high") - F.col("pos")
    lower = down.isNotNull() & (up.isNull() | (down <= up))
    near = rows.select("chrom", F.col("pos").alias("a"), F.when(lower, F.col("low")).otherwise(F.col("high")).alias("b"), F.when(lower, down).otherwise(up).alias("d"))
    return near.where(F.col("d") <= max_dist)


def mutual_nearest(first: DataFrame, second: DataFrame, max_dist: int = 100_000) -> DataFrame:
    """(chrom, a, b, d): borders that are each other's nearest."""
    there, back = nearest(first, second, max_dist), nearest(second, first, max_dist)
    return there.join(back.select("chrom", F.col("a").alias("b"), F.col("b").alias("a")), ["chrom", "a", "b"])


def align(borders: DataFrame, method: str = "reciprocal", **options) -> DataFrame:
    """(chrom, column, experiment, pos, score): progressive alignment of (experiment, chrom, pos), one chromosome a task."""
    chrom = dict(borders.dtypes)["chrom"]

    def kernel(key, pdf):
        names = sorted(pdf["experiment"].unique())
        rows, score = progressive([sorted(pdf.loc[pdf["experiment"] == n, "pos"].astype(float)) for n in names], method, **options)
        out = [(key[0], c, n, r[c], score) for n, r in zip(names, rows, strict=True) for c in range(len(r))]
        return pd.DataFrame(out, columns=["chrom", "column", "experiment", "pos", "score"])

    return ship(borders).groupBy("chrom").applyInPandas(kernel, f"chrom {chrom}, column int, experiment string, pos double, score double")


def columns_where(alignment: DataFrame, condition, min_num: int) -> DataFrame:
    """(chrom, column): alignment columns in which at least ``min_num`` experiments meet a column condition."""
    return alignment.groupBy("chrom", "column").agg(F.count_if(condition).alias("n")).where(F.col("n") >= min_num).select("chrom", "column")


def shuffled(borders: list[float], seed: int) -> list[float]:
    """Borders with their domain lengths shuffled."""
    lengths = lengths_of(borders)
    random.Random(seed).shuffle(lengths)
    out, at = [], 0.0
    for x in lengths:
        at += x
        out.append(at)
    return out


def lengths_of(borders: list[float]) -> list[float]:
    return [b - a for a, b in zip([0, *borders], borders, strict=False)]


def interpolated(lengths: list[float], size: float, seed: int) -> list[float]:
    """Borders on ``size`` with domain lengths drawn from the interpolated distribution of ``lengths``."""
    known = sorted(lengths)
    rng, out, at = random.Random(seed), [], 0.0
    while known and at < size:
        x = rng.random() * (len(known) - 1)
        i = int(x)
        at += max(known[i] + (x - i) * (known[min(i + 1, len(known) - 1)] - known[i]), 1.0)
        out.append(at)
    return out


def randomization_test(borders: DataFrame, runs: int = 1000, method: str = "interpolate", **options) -> DataFrame:
    """(chrom, score, p): share of random border sets that align better than the real ones.

    ``interpolate`` draws every set from the lengths of all experiments together, ``shuffle``
    shuffles the lengths of an experiment drawn at random.  Runs are dealt over tasks by seed.
    """
    chrom = dict(borders.dtypes)["chrom"]

    def drawn(real: list[list[float]], run: int) -> list[list[float]]:
        rng = random.Random(run)
        if method == "shuffle":
            return [shuffled(rng.choice(real), run * 1000 + k) for k in range(len(real))]
        pooled, size = [x for r in real for x in lengths_of(r)], max((r[-1] for r in real if r), default=0.0)
        return [interpolated(pooled, size, run * 1000 + k) for k in range(len(real))]

    def kernel(key, pdf):
        names = sorted(pdf["experiment"].unique())
        real = [sorted(pdf.loc[pdf["experiment"] == n, "pos"].astype(float)) for n in names]
        run = int(key[1])
        used = real if run < 0 else drawn(real, run)
        return pd.DataFrame([(key[0], run, progressive(used, "reciprocal", **({"max_dist": 100_000} | options))[1])], columns=["chrom", "run", "score"])

    each = borders.withColumn("run", F.explode(F.sequence(F.lit(-1), F.lit(runs - 1))))
    scored = ship(each).groupBy("chrom", "run").applyInPandas(kernel, f"chrom {chrom}, run int, score double")
    real = scored.where("run = -1").select("chrom", F.col("score").alias("real"))
    return scored.where("run >= 0").join(real, "chrom").groupBy("chrom", F.col("real").alias("score").alias("s")).agg(
        F.avg((F.col("score") > F.col("real")).cast("double")).alias("p")
    ).select("chrom", F.col("s").alias("score"), "p")


# --- remapping ----------------------------------------------------------------


def overlapping(segments: DataFrame, blocks: DataFrame, width: int = 100_000, least: int = 10) -> DataFrame:
    """Segments (id, chrom, start, end) with the block (chrom, bstart, bend, ...) that overlaps them most, by more than ``least``, and the number ``met`` of such blocks.

    Both sides are exploded to buckets of ``width`` and equi-joined; pairs met in
    several buckets are kept where their overlap starts.
    """
    bucketed = lambda df, a, b: df.withColumn("k", F.explode(F.sequence(F.floor(F.col(a) / width).cast("long"), F.floor(F.col(b) / width).cast("long"))))
    rows = bucketed(segments, "start", "end").join(bucketed(blocks, "bstart", "bend"), ["chrom", "k"])
    first = F.greatest("start", "bstart")
    rows = rows.withColumn("overlap", F.least("end", "bend") - first).where((F.col("overlap") > least) & (F.floor(first / width) == F.col("k")))
    order = Window.partitionBy("id").orderBy(F.desc("overlap"), "bstart", "bend")
    met = F.count("*").over(Window.partitionBy("id"))
    return rows.withColumns({"n": F.row_number().over(order), "met": met}).where("n = 1").drop("n", "k")


def lift(segments: DataFrame, blocks: DataFrame, **options) -> DataFrame:
    """(id, chrom, start, end) moved through blocks with (tchrom, tstart, tend, tstrand), proportionally inside a block."""
    return _lifted(segments, blocks, **options).drop("met")


def _lifted(segments: DataFrame, blocks: DataFrame, **options) -> DataFrame:
    rows = overlapping(segments, blocks, **options)
    rate = (F.col("tend") - F.col("tstart")) / (F.col("bend") - F.col("bstart"))
    clip = lambda c: F.least(F.greatest(F.col(c), F.col("bstart")), F.col("bend")) - F.col("bstart")
    a, b = F.round(clip("start") * rate), F.round(clip("end") * rate)
    forward = F.col("tstrand") >= 0
    return rows.select(
        "id",
        F.col("tchrom").alias("chrom"),
        F.when(forward, F.col("tstart") + a).otherwise(F.col("tend") - b).cast("long").alias("start"),
        F.when(forward, F.col("tstart") + b).otherwise(F.col("tend") - a).cast("long").alias("end"),
        "met",
    )


def remapped(marks: DataFrame, resolution: int, assembly: DataFrame | None = None, synteny: DataFrame | None = None, names: str | None = None, **options) -> DataFrame:
    """The trace of domain borders (chrom, end: a domain's last bin) through an assembly map, then a synteny map: one row a border.

    A border is the span of its bin.  Both maps are blocks as of ``lift``; a step without a map keeps the span.  Columns: chrom, end;
    mid_chrom, mid_start, mid_end after the first step; to_chrom, to_start, to_end after the second; to_bin, the
    last bin of the domain there, the span's end by ``resolution``, rounded; and status:

    * ``lost in assembly``, ``lost in synteny``: no block of that step overlaps the span by more than ``least``;
    * ``off names``: the target's chromosome does not match the pattern ``names``;
    * ``merged``: other borders come to the same bin; ``split``: the span met several blocks and went with the
      largest overlap; ``moved``: neither.

    Equal borders count once; borders with a null in either column are left out.
    """
    ids = F.concat_ws(":", F.col("end").cast("string"), F.col("chrom").cast("string"))
    spans = marks.where("chrom is not null and end is not null").select("chrom", "end").distinct().withColumn("id", ids)
    here = spans.select("id", "chrom", (F.col("end") * resolution).cast("long").alias("start"), ((F.col("end") + 1) * resolution).cast("long").alias("end"))
    still = lambda rows: rows.withColumn("met", F.lit(1).cast("long"))
    first = still(here) if assembly is None else _lifted(here, assembly, **options)
    second = still(first.drop("met")) if synteny is None else _lifted(first.drop("met"), synteny, **options)
    second = second.withColumn("to_bin", F.round(F.col("end") / resolution).cast("long"))
    named = F.lit(True) if names is None else F.col("to_chrom").cast("string").rlike(names)
    second = second.select("id", F.col("chrom").alias("to_chrom"), F.col("start").alias("to_start"), F.col("end").alias("to_end"), "to_bin", F.col("met").alias("met2"))
    # Lost borders have no target and so stay out of this window.
    second = second.withColumn("good", named).withColumn("shared", F.count("*").over(Window.partitionBy("to_chrom", "to_bin")))
    first = first.select("id", F.col("chrom").alias("mid_chrom"), F.col("start").alias("mid_start"), F.col("end").alias("mid_end"), F.col("met").alias("met1"))
    rows = spans.join(first, "id", "left").join(second, "id", "left")
    status = (
        F.when(F.col("met1").isNull(), "lost in assembly").when(F.col("met2").isNull(), "lost in synteny").when(~F.col("good"), "off names")
        .when(F.col("shared") > 1, "merged").when((F.col("met1") > 1) | (F.col("met2") > 1), "split").otherwise("moved")
    )
    return rows.select("chrom", "end", "mid_chrom", "mid_start", "mid_end", "to_chrom", "to_start", "to_end", "to_bin", status.alias("status"))


def remapped_domains(domains: DataFrame, trace: DataFrame) -> DataFrame:
    """(chrom, start, end, score) of domains (chrom, end, score) on the target of their borders' trace; merged borders keep the best score."""
    kept = trace.where("status in ('moved', 'split', 'merged')").select("chrom", "end", "to_chrom", "to_bin")
    rows = domains.select("chrom", "end", "score").join(kept, ["chrom", "end"])
    return reordered(rows.select(F.col("to_chrom").alias("chrom"), F.col("to_bin").alias("end"), "score")).select("chrom", "start", "end", "score")


def reordered(domains: DataFrame) -> DataFrame:
    """Domains sorted by end, equal ends merged with the best score, starts rebuilt after the end before."""
    merged = domains.groupBy("chrom", "end").agg(F.max("score").alias("score"))
    before = F.lag("end").over(Window.partitionBy("chrom").orderBy("end"))
    return merged.withColumn("start", F.coalesce(before + 1, F.lit(0)))


def syntenic(alignments: DataFrame, synteny: DataFrame, grid: int = 100) -> DataFrame:
    """Alignments whose source and target both meet one synteny block, compared on a grid."""
    cells = lambda df, a, b: F.explode(F.sequence(F.floor(F.col(a) / grid).cast("long"), F.floor(F.col(b) / grid).cast("long")))
    s = synteny.withColumn("g", cells(synteny, "sstart", "send")).select("schrom", "g", "tchrom", F.col("tstart").alias("y0"), F.col("tend").alias("y1")).distinct()
    rows = alignments.withColumn("g", cells(alignments, "bstart", "bend")).withColumnRenamed("chrom", "schrom")
    met = rows.join(s, ["schrom", "g", "tchrom"]).where((F.col("tstart") <= F.col("y1")) & (F.col("tend") >= F.col("y0")))
    return met.withColumnRenamed("schrom", "chrom").select(*alignments.columns).distinct()


def merged_blocks(blocks: DataFrame, gap: int = 0) -> DataFrame:
    """Neighbouring blocks of equal chromosomes and strand joined where both sides continue within ``gap``."""
    w = Window.partitionBy("chrom", "tchrom", "tstrand").orderBy("bstart")
    follows = (F.col("bstart") - F.lag("bend").over(w) <= gap) & (F.abs(F.col("tstart") - F.lag("tend").over(w)) <= gap)
    island = F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(w)
    return blocks.withColumn("g", island).groupBy("chrom", "tchrom", "tstrand", "g").agg(
        F.min("bstart").alias("bstart"), F.max("bend").alias("bend"), F.min("tstart").alias("tstart"), F.max("tend").alias("tend")
    ).drop("g")
