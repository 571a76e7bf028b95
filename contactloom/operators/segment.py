"""Domains, borders and compartments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions import hmm
from contactloom.functions.linear import correlation, dense, eigenvectors, spearman, ward
from contactloom.functions.segmentation import borders_from_insulation, window_domains
from contactloom.operators import likelihood, spectral
from contactloom.shipping import ship


def insulation(cells: DataFrame, bins: DataFrame, near: int, far: int, normalize: bool = False) -> DataFrame:
    """(chrom, idx, score): sum of the cells i in [x - far, x - near], j in [x + near, x + far] of every bin x.

    Each cell is exploded to the at most far - near + 1 bins it belongs to, so the
    shuffle carries sums of a band, not a range join.  Bins nearer than ``far`` to a
    chromosome's end are left out.  ``normalize`` takes log2 of the ratio to the mean.
    """
    place = bins.select("bin", "chrom", "idx")
    size = bins.groupBy("chrom").agg(F.count("*").alias("size"))
    band = cells.where((F.col("j") - F.col("i")).between(2 * near, 2 * far))
    rows = band.join(place.toDF("i", "chrom", "x"), "i").join(place.toDF("j", "cj", "y"), "j").where("chrom = cj")
    low, high = F.greatest(F.col("x") + near, F.col("y") - far), F.least(F.col("x") + far, F.col("y") - near)
    rows = rows.where(low <= high).select("chrom", F.explode(F.sequence(low, high)).alias("idx"), "v")
    sums = rows.groupBy("chrom", "idx").agg(F.sum("v").cast("double").alias("score"))
    inner = place.join(size, "chrom").where((F.col("idx") >= far) & (F.col("idx") < F.col("size") - far)).select("chrom", "idx")
    found = inner.join(sums, ["chrom", "idx"], "left").fillna(0.0, ["score"])
    if normalize:
        mean = F.avg("score").over(Window.partitionBy("chrom"))
        ratio = F.try_divide(F.col("score"), mean)
        found = found.withColumn("score", F.when(ratio > 0, F.log2(ratio)))
    return found


def insulation_delta(score: DataFrame, delta: int) -> DataFrame:
    """Scores with ``delta``: mean of the bins before minus mean of the bins after, the bin itself excluded."""
    w = Window.partitionBy("chrom").orderBy("idx")
    before, after = F.avg("score").over(w.rowsBetween(-delta, -1)), F.avg("score").over(w.rowsBetween(1, delta))
    return score.withColumn("delta", before - after)


def insulation_borders(deltas: DataFrame, min_strength: float = 0.1) -> DataFrame:
    """(chrom, idx, strength) of insulation borders."""
    chrom = dict(deltas.dtypes)["chrom"]

    def kernel(key, pdf):
        pdf = pdf.sort_values("idx")
        clean = lambda s: [None if v is None or v != v else float(v) for v in s]
        found = borders_from_insulation(clean(pdf.score), clean(pdf.delta), min_strength)
        idx = pdf.idx.tolist()
        return pd.DataFrame([(key[0], idx[x], s) for x, s in found], columns=["chrom", "idx", "strength"])

    return ship(deltas).groupBy("chrom").applyInPandas(kernel, f"chrom {chrom}, idx long, strength double")


def chromosome_cells(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """(chrom, n, i, j, v): cis cells with indices inside their chromosome."""
    place = bins.select("bin", "chrom", "idx")
    size = bins.groupBy("chrom").agg(F.count("*").alias("n"))
    rows = cells.join(place.toDF("i", "chrom", "x"), "i").join(place.toDF("j", "cj", "y"), "j").where("chrom = cj")
    return rows.select("chrom", F.col("x").alias("i"), F.col("y").alias("j"), F.col("v").cast("double").alias("v")).join(size, "chrom")


#: Bins of the largest chromosome whose dense map a task takes.
MAX_DENSE = 12_000


def _dense(pdf: pd.DataFrame) -> np.ndarray:
    n = int(pdf["n"].iloc[0])
    if n > MAX_DENSE:
        raise ValueError(f"{n} bins are too many for a dense map; use a coarser resolution or a region")
    return dense(pdf, n)


def domains_by_window(cells: DataFrame, bins: DataFrame, window: int, test: bool = True) -> DataFrame:
    """(chrom, start, end, kind, p) by diamond means and rank tests, one chromosome a task; p is the mean of a domain's bins."""
    rows = chromosome_cells(cells, bins)
    chrom = dict(rows.dtypes)["chrom"]

    def kernel(key, pdf):
        return pd.DataFrame([(key[0], *d) for d in window_domains(_dense(pdf), window, test)], columns=["chrom", "start", "end", "kind", "p"])

    return ship(rows).groupBy("chrom").applyInPandas(kernel, f"chrom {chrom}, start long, end long, kind string, p double")


def domains_by_likelihood(cells: DataFrame, bins: DataFrame, bad: DataFrame | None = None, longest: int | None = None, parts: int = 16, width: int = 128) -> DataFrame:
    """(chrom, start, end, score) by optimal segmentation into domains of any length, or of at most ``longest`` bins.

    Chromosomes of at most ``width`` bins are searched exactly, longer ones from coarse to
    fine (``operators/likelihood.py``); a round's fits are dealt over ``parts`` tasks a chromosome.
    """
    return likelihood.domains(cells, bins, bad, longest, parts, width)


def domain_density(domains: DataFrame, cells: DataFrame, bins: DataFrame) -> DataFrame:
    """(chrom, start, end, observed, expected, height): contacts inside domains against the mean of their diagonals.

    Cells meet their domain by the domain of their row bin, an equi-join on bins.
    """
    rows = chromosome_cells(cells.where("i <= j"), bins)
    spread = domains.select("chrom", "start", "end", F.explode(F.sequence("start", "end")).alias("i"))
    inside = rows.join(spread, ["chrom", "i"]).where("j <= end")
    observed = inside.groupBy("chrom", "start", "end").agg(F.sum("v").alias("observed"))
    size = bins.groupBy("chrom").agg(F.count("*").alias("n"))
    mean = rows.groupBy("chrom", (F.col("j") - F.col("i")).alias("k")).agg(F.sum("v").alias("s")).join(size, "chrom")
    mean = mean.select("chrom", "k", (F.col("s") / (F.col("n") - F.col("k"))).alias("m"))
    width = domains.select("chrom", "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.col("end") - F.col("start"))).alias("k"))
    expected = width.join(mean, ["chrom", "k"], "left").groupBy("chrom", "start", "end")
    expected = expected.agg(F.sum(F.coalesce("m", F.lit(0.0)) * (F.col("end") - F.col("start") + 1 - F.col("k"))).alias("expected"))
    return (
        domains.select("chrom", "start", "end").join(observed, ["chrom", "start", "end"], "left").join(expected, ["chrom", "start", "end"])
        .withColumn("observed", F.coalesce("observed", F.lit(0.0)))
        .withColumn("height", F.try_divide(F.col("observed"), F.col("expected")))
    )


def limit_domains(domains: DataFrame, most: int) -> DataFrame:
    """Scores of domains longer than ``most`` bins become negative, others positive."""
    long = F.col("end") - F.col("start") + 1 > most
    return domains.withColumn("score", F.when(long, -F.abs("score")).otherwise(F.abs("score")))


def forbidden(domains: DataFrame, most: int) -> DataFrame:
    """(chrom, idx): bins in too long domains of every experiment of (experiment, chrom, start, end)."""
    n = domains.select("experiment").distinct().agg(F.count("*").alias("k"))
    rows = domains.where(F.col("end") - F.col("start") + 1 > most).select("experiment", "chrom", F.explode(F.sequence("start", "end")).alias("idx"))
    counted = rows.groupBy("chrom", "idx").agg(F.countDistinct("experiment").alias("e"))
    return counted.join(F.broadcast(n), F.col("e") == F.col("k")).select("chrom", "idx")


def longest_gap(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """(chrom, first, last, n): the longest run of empty bins of each chromosome, its centromere."""
    used = cells.where("v <> 0").select(F.col("i").alias("bin")).distinct()
    empty = bins.join(used, "bin", "left_anti")
    island = F.col("idx") - F.row_number().over(Window.partitionBy("chrom").orderBy("idx"))
    runs = empty.withColumn("g", island).groupBy("chrom", "g").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n"))
    best = F.max_by(F.struct("first", "last", "n"), F.struct("n", -F.col("first")))
    return runs.groupBy("chrom").agg(best.alias("r")).select("chrom", "r.first", "r.last", "r.n")


def split_at(domains: DataFrame, gaps: DataFrame) -> DataFrame:
    """Domains cut where they meet the gap (chrom, first, last): the part before and the part after it."""
    rows = domains.join(gaps.select("chrom", "first", "last"), "chrom", "left")
    meets = (F.col("start") <= F.col("last")) & (F.col("end") >= F.col("first"))
    parts = F.array(F.struct(F.col("start"), F.col("first") - 1), F.struct(F.col("last") + 1, F.col("end")))
    whole = F.array(F.struct("start", "end"))
    cut = rows.select(*[c for c in domains.columns if c not in ("start", "end")], F.explode(F.when(meets, parts).otherwise(whole)).alias("p"))
    return cut.select("*", F.col("p.start").alias("start"), F.col("p.end").alias("end")).drop("p").where("start <= end")


#: Bins of the largest chromosome whose correlation map a task makes; larger ones go by the sparse iteration.
DENSE = 4_000
_RUNS = ["chrom", "start", "end", "vector", "value", "type", "density"]


def _runs(chrom, n: int, used: np.ndarray, v: np.ndarray, rich, ev: int, labels: str) -> pd.DataFrame:
    """Runs of one state of a chromosome's vector over its used bins."""
    track = None
    if rich is not None:
        track = np.array([x if x is not None else np.nan for x in rich], dtype=float)[used]
        ok = ~np.isnan(track)
        if ok.sum() > 2 and spearman(v[ok], track[ok]) < 0:
            v = -v
    state = (v > 0).astype(int) if labels == "sign" else hmm.segment(v)
    names = ["B", "A"] if labels == "sign" or state.max() < 2 else ["B", *["b" if k < state.max() / 2 else "I" if k == state.max() / 2 else "a" for k in range(1, state.max())], "A"]
    edges = np.flatnonzero(np.r_[True, state[1:] != state[:-1], True])
    out = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        start = 0 if a == 0 else out[-1][2] + 1
        end = n - 1 if b == len(used) else int(used[b - 1])
        part = track[a:b] if track is not None else None
        density = float(np.nanmean(part)) if part is not None and not np.isnan(part).all() else None
        out.append((chrom, start, end, ev, float(v[a:b].mean()), names[int(state[a])], density))
    return pd.DataFrame(out, columns=_RUNS)


def _dense_runs(max_ev: int, ev: int, labels: str):
    """From the cells of one chromosome."""

    def kernel(key, pdf):
        m = _dense(pdf)
        used = np.flatnonzero(m.sum(axis=0) > 0)
        if len(used) < 3:
            return pd.DataFrame(columns=_RUNS)
        vectors = eigenvectors(correlation(m[np.ix_(used, used)]), max_ev)
        rich = pdf["rich"].iloc[0] if "rich" in pdf else None
        return _runs(key[0], len(m), used, vectors[:, min(ev, vectors.shape[1]) - 1], rich, ev, labels)

    return kernel


def _vector_runs(ev: int, labels: str):
    """From the vectors of one chromosome."""

    def kernel(key, pdf):
        pdf = pdf.sort_values("idx")
        if len(pdf) < 3:
            return pd.DataFrame(columns=_RUNS)
        v = np.stack([np.asarray(x, dtype=float) for x in pdf["vectors"]])
        rich = pdf["rich"].dropna().iloc[0] if "rich" in pdf else None
        return _runs(key[0], int(pdf["n"].iloc[0]), pdf["idx"].to_numpy(), v[:, min(ev, v.shape[1]) - 1], rich, ev, labels)

    return kernel


def compartments(
    cells: DataFrame, bins: DataFrame, decay: DataFrame, rich_in_a: DataFrame | None = None, max_ev: int = 3, ev: int = 1, labels: str = "sign", dense_limit: int = DENSE
) -> DataFrame:
    """(chrom, start, end, vector, value, type, density): runs of the sign (or of HMM states) of a chromosome's eigenvector.

    The observed over expected map is made by joins.  Chromosomes of at most ``dense_limit`` bins take
    their correlation map in a task; those of larger ones stay sparse (see ``spectral``).
    ``rich_in_a`` (chrom, idx, value) sets the sign; without it
    the first non-zero entry is positive.  Empty bins join the run before them.
    """
    rows = chromosome_cells(cells, bins).withColumn("dist", F.abs(F.col("i") - F.col("j")))
    rows = rows.join(decay, ["chrom", "dist"]).withColumn("v", F.coalesce(F.try_divide("v", "expected"), F.lit(0.0)))
    rows = rows.select("chrom", "n", "i", "j", "v")
    track = None
    if rich_in_a is not None:
        filled = bins.select("chrom", "idx").join(rich_in_a.select("chrom", "idx", "value"), ["chrom", "idx"], "left")
        track = filled.groupBy("chrom").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"]).alias("rich"))
    with_track = lambda df: df if track is None else df.join(track, "chrom", "left")
    schema = f"chrom {dict(rows.dtypes)['chrom']}, start long, end long, vector int, value double, type string, density double"
    sizes = bins.groupBy("chrom").agg(F.count("*").alias("n"))
    found = ship(with_track(rows.where(F.col("n") <= dense_limit))).groupBy("chrom").applyInPandas(_dense_runs(max_ev, ev, labels), schema)
    if sizes.where(F.col("n") > dense_limit).isEmpty():
        return found
    vectors = spectral.leading_vectors(rows.where(F.col("n") > dense_limit), max_ev).join(sizes, "chrom")
    if track is not None:
        # One row of each chromosome carries the track.
        least = F.min("idx").over(Window.partitionBy("chrom")) == F.col("idx")
        vectors = vectors.withColumn("first", least).join(track, "chrom", "left").withColumn("rich", F.when(F.col("first"), F.col("rich"))).drop("first")
    return found.unionByName(vectors.groupBy("chrom").applyInPandas(_vector_runs(ev, labels), schema))


def cluster_segments(profiles: DataFrame, k: int = 2) -> DataFrame:
    """(chrom, segment, cluster) by Ward's rule on the correlation of (chrom, segment, profile array)."""
    chrom = dict(profiles.dtypes)["chrom"]

    def kernel(key, pdf):
        m = np.array(pdf["profile"].tolist(), dtype=float)
        label = ward(1 - correlation(m), min(k, len(m)))
        return pd.DataFrame({"chrom": key[0], "segment": pdf["segment"], "cluster": label})

    return ship(profiles).groupBy("chrom").applyInPandas(kernel, f"chrom {chrom}, segment long, cluster int")


def observed_over_distance(cells: DataFrame, domains: DataFrame, bins: DataFrame, how: str = "ratio") -> DataFrame:
    """(chrom, start, end, density): contacts within segments per cell, relative to the chromosome's mean density."""
    rows = chromosome_cells(cells.where("i <= j"), bins)
    spread = domains.select("chrom", "start", "end", F.explode(F.sequence("start", "end")).alias("i"))
    n = F.col("end") - F.col("start") + 1
    sums = rows.join(spread, ["chrom", "i"]).where("j <= end").groupBy("chrom", "start", "end").agg(F.sum("v").alias("s"))
    raw = sums.select("chrom", "start", "end", (F.col("s") / (n * (n + 1) / 2)).alias("density"))
    return raw.withColumn("density", F.try_divide("density", F.avg("density").over(Window.partitionBy("chrom"))))
