"""Biases of bins, rescaling and distance decay."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators.pixels import good, with_bias
from contactloom.shipping import ship


#: Bins whose biases are broadcast (16 bytes each); beyond that they are joined.
MAX_BROADCAST_BINS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; only a local session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="ckpt")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _by_mean(sums: DataFrame) -> DataFrame:
    """b = S / mean * sqrt(mean) from (bin, s)."""
    mean = sums.agg(F.avg("s").alias("m"))
    return sums.crossJoin(F.broadcast(mean)).select("bin", (F.col("s") / F.col("m") * F.sqrt("m")).alias("b"))


def row_sums(cells: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    cells = good(cells, bad) if bad is not None else cells
    return cells.groupBy(F.col("i").alias("bin")).agg(F.sum("v").cast("double").alias("s"))


def vanilla(cells: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """(bin, b) by coverage: one round of balancing."""
    return _by_mean(row_sums(cells, bad))


def square_root(cells: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """Coverage biases of the square roots of the row sums."""
    return _by_mean(row_sums(cells, bad).withColumn("s", F.sqrt("s")))


def iterative(cells: DataFrame, bad: DataFrame | None = None, iterations: int = 0, max_dev: float = 1e-5) -> DataFrame:
    """(bin, b) by iterative balancing; ``iterations=0`` is one round.

    Only the biases change: a round sums v / (B_i B_j) per row over the same cells.
    The cells are dealt by row and written once, so that a round's sums need no shuffle of
    the map while the biases are few enough to broadcast; the state is one row per bin,
    checkpointed in every round.
    """
    cells = good(cells, bad) if bad is not None else cells
    cells = checkpointed(cells.select("i", "j", "v"))
    bias = checkpointed(cells.select(F.col("i").alias("bin")).distinct().withColumn("b", F.lit(1.0)))
    small = bias.count() <= MAX_BROADCAST_BINS
    mean = 1.0
    for _ in range(iterations + 1):
        sent = F.broadcast(bias) if small else bias
        sums = with_bias(cells, sent).groupBy("i").agg(F.sum(F.col("v") / F.col("bi") / F.col("bj")).alias("s"))
        joined = checkpointed(sums.withColumnRenamed("i", "bin").join(sent, "bin"))
        low, high, mean = joined.agg(F.min("s"), F.max("s"), F.avg("s")).first()
        if mean is None:
            return bias
        bias = joined.select("bin", (F.col("b") * F.col("s") / mean).alias("b"))
        if max(abs(low / mean - 1), abs(high / mean - 1)) < max_dev:
            break
    return bias.select("bin", F.when(F.col("b") == 0, 1.0).otherwise(F.col("b") * mean**0.5).alias("b"))


def rescaled(cells: DataFrame, bias: DataFrame, n_bins: int, factor: float = 1.0) -> DataFrame:
    """Biases such that the normalised map has the mean ``factor``; all ``n_bins`` bins count."""
    total = with_bias(cells, bias).agg(F.sum(F.col("v") / F.col("bi") / F.col("bj")).alias("t"))
    scale = F.sqrt(F.col("t") / (float(n_bins) ** 2 * factor))
    return bias.crossJoin(F.broadcast(total)).select("bin", (F.col("b") * scale).alias("b"))


def distance_sums(cells: DataFrame, bins: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """(chrom, dist, raw, nrm): cis totals per distance over i >= j, the diagonal included."""
    chrom = lambda side: bins.select(F.col("bin").alias(side), F.col("chrom").alias(f"c{side}"))
    half = cells.where("i >= j")
    half = with_bias(half, bias) if bias is not None else half.withColumns({"bi": F.lit(1.0), "bj": F.lit(1.0)})
    cis = half.join(chrom("i"), "i").join(chrom("j"), "j").where("ci = cj")
    return cis.groupBy(F.col("ci").alias("chrom"), (F.col("i") - F.col("j")).alias("dist")).agg(
        F.sum("v").cast("double").alias("raw"), F.sum(F.col("v") / F.col("bi") / F.col("bj")).alias("nrm")
    )


def distance_cells(bins: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """(chrom, dist, cells): good cells per distance of every chromosome.

    With bad bins a chromosome's good ones are one vector of bits, and the pairs of good
    bins per distance are its autocorrelation, by fast Fourier transform in one task a chromosome.
    """
    size = bins.groupBy("chrom").agg(F.count("*").alias("size"))
    if bad is None:
        every = size.select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("dist"))
        return every.select("chrom", "dist", (F.col("size") - F.col("dist")).alias("cells"))
    marked = bins.select("bin", "chrom", "idx").join(bad.select("bin", F.lit(1).alias("bad")).distinct(), "bin", "left").select("chrom", "idx", "bad")
    chrom = dict(marked.dtypes)["chrom"]

    def count(key, pdf):
        n = int(pdf["idx"].max()) + 1
        ok = np.zeros(n)
        ok[pdf.loc[pdf["bad"].isna(), "idx"].to_numpy()] = 1.0
        spectrum = np.fft.rfft(ok, 2 * n)
        cells = np.rint(np.fft.irfft(spectrum * np.conj(spectrum), 2 * n)[:n]).astype(np.int64)
        return pd.DataFrame({"chrom": key[0], "dist": np.arange(n), "cells": cells})

    return ship(marked).groupBy("chrom").applyInPandas(count, f"chrom {chrom}, dist long, cells long")


def _grouped(minimum: float):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """Distances upward until the raw sum exceeds the minimum; the rest joins the last full group's mean."""
        pdf = pdf.sort_values("dist").reset_index(drop=True)
        expected, open_, raw, nrm, cells, last = [None] * len(pdf), [], 0.0, 0.0, 0, None
        for k, row in enumerate(pdf.itertuples()):
            open_.append(k)
            raw, nrm, cells = raw + row.raw, nrm + row.nrm, cells + row.cells
            if raw > minimum:
                for x in open_:
                    expected[x] = nrm / cells if cells else None
                last, open_, raw, nrm, cells = (nrm, cells), [], 0.0, 0.0, 0
        if last is None:
            return pd.DataFrame({"chrom": pdf.chrom, "dist": pdf.dist, "expected": expected}).iloc[:0].astype({"expected": float})
        for x in open_:
            expected[x] = (last[0] + nrm) / (last[1] + cells) if last[1] + cells else None
        return pd.DataFrame({"chrom": pdf.chrom, "dist": pdf.dist, "expected": expected})

    return fold


def decay(cells: DataFrame, bins: DataFrame, bias: DataFrame | None = None, bad: DataFrame | None = None, minimum: float = 400) -> DataFrame:
    """(chrom, dist, expected): mean per distance, neighbouring distances pooled until their raw sum exceeds ``minimum``.

    The fold runs per chromosome on one row per distance.
    """
    cells = good(cells, bad) if bad is not None else cells
    sums = distance_cells(bins, bad).join(distance_sums(cells, bins, bias), ["chrom", "dist"], "left").fillna(0.0, ["raw", "nrm"])
    chrom = dict(sums.dtypes)["chrom"]
    return ship(sums).groupBy("chrom").applyInPandas(_grouped(minimum), f"chrom {chrom}, dist long, expected double")


def cis_percent(cells: DataFrame, bins: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """One row cis, total: normalised sums over i > j."""
    chrom = lambda side: bins.select(F.col("bin").alias(side), F.col("chrom").alias(f"c{side}"))
    half = cells.where("i > j")
    half = with_bias(half, bias) if bias is not None else half.withColumns({"bi": F.lit(1.0), "bj": F.lit(1.0)})
    v = F.col("v") / F.col("bi") / F.col("bj")
    rows = half.join(chrom("i"), "i").join(chrom("j"), "j")
    return rows.agg(F.sum(F.when(F.col("ci") == F.col("cj"), v).otherwise(0.0)).alias("cis"), F.sum(v).alias("total"))


def _curves(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Natural cubic spline columns of one covariate: straight beyond the outer knots."""
    last, before = knots[-1], knots[-2]
    cube = lambda k: np.maximum(x - k, 0) ** 3
    bend = lambda k: (cube(k) - cube(last)) / (last - k)
    return np.stack([x, *[bend(k) - bend(before) for k in knots[:-2]]], axis=1)


def additive_fit(total: np.ndarray, covariates: np.ndarray, n_knots: int = 7, ridge: float = 1e-3, rounds: int = 50):
    """Poisson regression of totals on smooth curves of the covariates: a function that predicts the mean total of rows.

    Curves are natural cubic splines on quantiles, in units of each column's deviation,
    with a small ridge; fitted by iteratively reweighted least squares.
    """
    knots = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, n_knots))) for c in covariates.T]

    def design(rows: np.ndarray) -> np.ndarray:
        parts = [_curves(c, k) if len(k) > 2 else c[:, None] for c, k in zip(rows.T, knots, strict=True)]
        return np.concatenate([np.ones((len(rows), 1)), *parts], axis=1)

    x = design(covariates)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[0] = 0.0, 1.0
    scale[scale == 0] = 1.0
    z = (x - mean) / scale
    w = np.zeros(z.shape[1])
    w[0] = np.log(max(total.mean(), 1e-9))
    penalty = ridge * len(z) * max(total.mean(), 1e-9) * np.eye(len(w))
    penalty[0, 0] = 0.0
    for _ in range(rounds):
        mu = np.exp(np.clip(z @ w, -30, 30))
        step = np.linalg.solve((z * mu[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (total - mu) - penalty @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return lambda rows: np.exp(np.clip((design(rows) - mean) / scale @ w, -30, 30))


def one_d(sums: DataFrame, covariates: DataFrame, names: tuple[str, ...] = ("map", "cg", "res"), p_fit: float | None = None, max_bins: int = 500_000, seed: int = 1) -> DataFrame:
    """(bin, b): biases from an additive model of row totals on mappability, GC content and cut sites of the bins.

    ``sums`` (bin, s); ``covariates`` (bin, ...).  The curves are fitted on the driver on at
    most ``max_bins`` bins with all values, or a share ``p_fit`` of them, chosen by a hash;
    every bin gets its predicted total, over the mean of the predictions.  The curves are
    regression splines of a Poisson model, where the usual additive model chooses its
    smoothness from the data, so biases agree in shape, not to the digit.
    """
    rows = sums.join(covariates.select("bin", *names), "bin").dropna()
    chosen = rows if p_fit is None else rows.where(F.pmod(F.xxhash64("bin", F.lit(seed)), F.lit(10_000)) < int(p_fit * 10_000))
    sample = chosen.orderBy(F.xxhash64("bin", F.lit(seed)), "bin").limit(max_bins).toPandas()
    if not len(sample):
        return sums.select("bin", F.lit(1.0).alias("b")).limit(0)
    predict = additive_fit(sample["s"].to_numpy(dtype=float), sample[list(names)].to_numpy(dtype=float))

    def fitted(batches):
        for pdf in batches:
            yield pd.DataFrame({"bin": pdf["bin"], "b": predict(pdf[list(names)].to_numpy(dtype=float)) if len(pdf) else []})

    kind = dict(rows.dtypes)["bin"]
    found = checkpointed(ship(rows).mapInPandas(fitted, f"bin {kind}, b double"))
    mean = found.agg(F.avg("b").alias("m"))
    return found.crossJoin(F.broadcast(mean)).select("bin", (F.col("b") / F.col("m")).alias("b"))
