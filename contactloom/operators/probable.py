"""Restraints and models from distributions of distances, in two resolutions.

A pair of particles has a distribution of distances: an exponentially modified normal one, a
normal part (``loc``, ``width``) plus an exponential part with mean ``k * width``.  Tables of
distributions have the columns (i, j, k, loc, width), i < j.  ``fitted`` takes them from an ensemble of
coordinates, ``expected`` from z-scores of a map; any other predictor's table can be passed.

Every model draws a distance of its own for each pair, by a hash of the seed, the model and the
pair, so that draws depend on no partitioning and can be repeated row by row.  ``restraints`` turns the
draws into restraints, ``placed`` into models.  ``parents`` does both for groups of particles at a coarse
resolution first; the distances of these parents then hold far particles of the fine models.

Defined cases: a null or NaN parameter, or a ``loc`` or ``width`` below the floor, makes a pair unknown;
pairs given twice count once, the least row of them; particles without any restraint stay at
their random start; a table without distributions leaves only the bounds between neighbours.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.models3d import distances
from contactloom.operators.normalize import checkpointed
from contactloom.operators.restraints import relaxed
from contactloom.shipping import ship

#: The exponential part's bounds, the least loc and width, the percentile that bounds empty pairs.
K_LEAST, K_MOST = 0.5, 1.5
FLOOR = 0.2
REACH = 0.9
#: Most steps of a model.  Forces of one model differ by factors of hundreds, so that far pairs move slowly: few hundred steps leave them half way.
STEPS = 5000


def fitted(particles: DataFrame, max_gap: int) -> DataFrame:
    """Distributions of the pairs at most ``max_gap`` particles apart, by the moments of their distances over models.

    Mean, variance and skewness of the distribution are loc + k width, width^2 (1 + k^2) and
    2 k^3 / (1 + k^2)^1.5; a skewness outside 0 to 2 is moved to its bound, where k is ``K_MOST``.
    A pair without variance has width 0.  Work and rows are in proportion to particles times ``max_gap``.
    """
    rows = particles.where(" and ".join(f"{c} is not null and not isnan({c})" for c in "xyz")).select("model", "particle", *"xyz")
    ahead = rows.select("model", *[F.col(c).alias(f"{c}2") for c in "xyz"], F.col("particle").alias("j"),
                        F.explode(F.sequence(F.col("particle") - max_gap, F.col("particle") - 1)).alias("i"))
    near = rows.withColumnRenamed("particle", "i").join(ahead, ["model", "i"])
    near = near.select("i", "j", F.sqrt(sum((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "xyz")).alias("d"))
    found = near.groupBy("i", "j").agg(F.avg("d").alias("m"), F.var_pop("d").alias("v"), F.skewness("d").alias("s"))
    part = F.pow(F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)) / 2, F.lit(2 / 3))  # k^2 / (1 + k^2)
    limit = K_MOST**2 / (1 + K_MOST**2)
    k = F.sqrt(F.least(part, F.lit(limit)) / (1 - F.least(part, F.lit(limit))))
    width = F.sqrt(F.greatest("v", F.lit(0.0)) / (1 + k * k))
    return found.select("i", "j", k.alias("k"), (F.col("m") - k * width).alias("loc"), width.alias("width"))


def expected(z: DataFrame, least: float, most: float, spread: float = 0.2, k: float = 1.0) -> DataFrame:
    """Distributions from z-scores (i, j, z), i < j: ``loc`` falls from ``most`` at the least z to ``least`` at the largest, ``width`` is ``spread`` of it."""
    z = z.where("i < j")
    line = z.agg(F.min("z").alias("low"), F.max("z").alias("high"))
    share = F.coalesce(F.try_divide(F.col("high") - F.col("z"), F.col("high") - F.col("low")), F.lit(0.5))
    loc = least + (most - least) * share
    return z.crossJoin(F.broadcast(line)).select("i", "j", F.lit(float(k)).alias("k"), loc.alias("loc"), (spread * loc).alias("width"))


def known(distributions: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(i, j, k, loc, width, known): one row a pair, k within its bounds."""
    rows = distributions.where("i < j").groupBy("i", "j").agg(F.min(F.struct("loc", "width", "k")).alias("p")).select("i", "j", "p.k", "p.loc", "p.width")
    good = F.lit(True)
    for c in ("k", "loc", "width"):
        good = good & F.col(c).isNotNull() & ~F.isnan(c)
    good = good & (F.col("loc") >= floor) & (F.col("width") >= floor)
    return rows.select("i", "j", F.least(F.greatest("k", F.lit(K_LEAST)), F.lit(K_MOST)).alias("k"), "loc", "width", good.alias("known"))


def _uniform(digest: Column, part: int) -> Column:
    """A number between 0 and 1 (neither) from 13 of the digest's hexadecimal digits."""
    return (F.conv(F.substring(digest, 13 * part + 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def _digest(seed: int, tag: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(f"{seed}{tag}"), *[F.col(c).cast("string") for c in ("model", "i", "j")]), 256)


def _models(models: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(models - 1).cast("long"))).alias("model")


def drawn(pairs: DataFrame, models: int, seed: int = 1) -> DataFrame:
    """(model, every column of ``pairs``, dist, place): a distance of each pair in each model, and the pair's random place from 0 to 1 in it."""
    rows = pairs.select(_models(models), "*").withColumn("h", _digest(seed, ""))
    normal = F.sqrt(-2 * F.log(_uniform(F.col("h"), 0))) * F.cos(2 * F.pi() * _uniform(F.col("h"), 1))
    slow = -F.log(_uniform(F.col("h"), 2))
    dist = F.col("loc") + F.col("width") * (normal + F.col("k") * slow)
    return rows.withColumn("dist", dist).withColumn("place", _uniform(F.col("h"), 3)).drop("h")


def independent(pairs: list[tuple[int, int]]) -> list[bool]:
    """Whether each pair (a, b), a < b, in the given order ties two particles that no kept pair ties to one particle below both."""
    below: defaultdict[int, set[int]] = defaultdict(set)
    kept = []
    for a, b in pairs:
        free = below[a].isdisjoint(below[b])
        if free:
            below[b].add(a)
        kept.append(free)
    return kept


def _thinned(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["place", "i", "j"])
    return pdf[independent(list(zip(pdf["i"], pdf["j"], strict=True)))]


def _empty_pairs(empty: DataFrame) -> DataFrame:
    """Pairs (i, j), j - i > 1, inside the runs of bins (bin) without data."""
    bins = empty.select(F.col("bin").cast("long").alias("bin")).distinct()
    runs = bins.withColumn("run", F.col("bin") - F.row_number().over(Window.orderBy("bin")))
    return runs.toDF("i", "run").join(runs.toDF("j", "run"), "run").where("j - i > 1").select("i", "j")


def restraints(
    distributions: DataFrame, n: int, models: int, radius: float, scale: float, kforce: float = 5.0, share: float = 0.3, seed: int = 1,
    empty: DataFrame | None = None, chains: list[int] | None = None, parents: DataFrame | None = None, groups: DataFrame | None = None, floor: float = FLOOR,
) -> DataFrame:
    """(model, i, j, type, kforce, dist) of every model, with distances in units of ``scale``, and ``radius`` in the same units.

    * Neighbours with a distribution: harmonic at their draw.  Neighbours of one chain without:
      an upper bound at the largest of the models' median draws of neighbours, two radii at least, with ten times the force.
    * Other pairs: a ``share`` of them is chosen anew in each model, in random order, and a pair is left out if kept ones already tie both its
      particles to one below them; harmonic at the draw, two radii at least.
    * Pairs inside a run of ``empty`` (bin) bins, and pairs whose distribution is unknown: a ``share`` of them,
      with an upper bound at the median, over the known pairs as far apart, of the 90th percentile of draws.
    * Far pairs from ``parents`` (model, a, b, d), in the units of the distributions, and ``groups`` (group, first, end: particles
      first .. end - 1): twice the ``share`` of the parents' pairs; harmonic between one random particle with data of each.

    Forces grow with nearness: ((top - loc + 1) / scale)^2 with the largest loc ``top``, and top / 4 / scale for pairs beyond three quarters of
    it, as for all far pairs.  A pair has one restraint, the first in this order.
    """
    spark = ship(distributions).sparkSession
    rows = known(distributions.where(F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1)), floor)
    gap = F.col("j") - F.col("i")
    top = F.broadcast(rows.where("known").agg(F.max("loc").alias("top")))
    weight = F.when(F.col("loc") > 0.75 * F.col("top"), F.col("top") / 4 / scale).otherwise(F.pow((F.col("top") - F.col("loc") + 1) / scale, F.lit(2.0)))
    rows = checkpointed(rows.crossJoin(top).withColumn("weight", weight))
    good = rows.where("known")
    draws = checkpointed(drawn(good.select("i", "j", "k", "loc", "width", "weight"), models, seed).select("model", "i", "j", "dist", "place", "weight"))
    out = lambda df, kind, force, dist, place: df.select(
        F.col("model").cast("long").alias("model"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"),
        F.lit(place).alias("place"), F.lit(kind).alias("type"), force.cast("double").alias("kforce"), dist.cast("double").alias("dist"),
    )

    chosen = draws.where((gap > 1) & (F.col("place") < share))
    chosen = chosen.groupBy("model").applyInPandas(_thinned, chosen.schema)
    force = kforce * F.col("weight")
    parts = [
        out(draws.where(gap == 1), "Harmonic", force, F.greatest(F.col("dist") / scale, F.lit(0.0)), 0),
        out(chosen, "Harmonic", force, F.greatest(F.col("dist") / scale, F.lit(2.0 * radius)), 1),
    ]

    by_gap = (
        draws.groupBy("i", "j").agg(F.percentile("dist", F.lit(REACH)).alias("reach"), F.first("weight").alias("weight"))
        .groupBy(gap.alias("gap")).agg(F.median("reach").alias("reach"), F.median("weight").alias("weight"))
    )
    close = draws.where(gap == 1).groupBy("model").agg(F.median("dist").alias("m")).agg(F.max("m").alias("close"))
    near = F.broadcast(close.crossJoin(F.broadcast(by_gap.where("gap = 1").agg(F.max("weight").alias("weight")))))
    ends = np.cumsum(chains or [n])
    steps = spark.range(max(n - 1, 0)).where(~F.col("id").isin([int(e) - 1 for e in ends])).select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    bare = steps.join(good.select("i", "j"), ["i", "j"], "left_anti").crossJoin(near).select(_models(models), "*")
    limit = F.greatest(F.coalesce(F.col("close") / scale, F.lit(0.0)), F.lit(2.0 * radius))
    parts.append(out(bare, "UpperBound", 10 * kforce * F.coalesce("weight", F.lit(2.0 * radius)), limit, 2))

    loose = rows.where(~F.col("known") & (gap > 1)).select("i", "j")
    if empty is not None:
        loose = loose.unionByName(_empty_pairs(empty.where(F.col("bin").between(0, n - 1)))).distinct()
    loose = loose.select(_models(models), "i", "j").where(_uniform(_digest(seed, "e"), 0) < share)
    loose = loose.withColumn("gap", gap).join(F.broadcast(by_gap), "gap")  # one row a distance between particles of the region
    parts.append(out(loose, "UpperBound", force, F.col("reach") / scale, 3))

    if parents is not None:
        bins = groups.select("group", F.explode(F.sequence("first", F.col("end") - 1)).alias("bin")).where(F.col("bin").between(0, n - 1))
        bins = bins.withColumn("bin", F.col("bin").cast("long"))
        if empty is not None:
            bins = bins.join(empty.select(F.col("bin").cast("long").alias("bin")).distinct(), "bin", "left_anti")
        inside = bins.groupBy("group").agg(F.sort_array(F.collect_set("bin")).alias("bins"))  # as many as a parent has children
        far = parents.select("model", F.col("a").alias("i"), F.col("b").alias("j"), "d").where("i < j and d > 0")
        far = far.withColumn("h", _digest(seed, "f")).where(_uniform(F.col("h"), 0) < 2 * share)
        far = far.join(inside.toDF("i", "one"), "i").join(inside.toDF("j", "two"), "j").crossJoin(top)
        pick = lambda c, k: F.element_at(c, F.floor(_uniform(F.col("h"), k) * F.size(c)).cast("int") + 1)
        far = far.select("model", "d", "top", pick("one", 1).alias("i"), pick("two", 2).alias("j")).where("i <> j")
        far = far.select("model", "d", "top", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        parts.append(out(far, "Harmonic", kforce * F.coalesce(F.col("top") / 4 / scale, F.lit(1.0)), F.col("d") / scale, 4))

    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    first = every.groupBy("model", "i", "j").agg(F.min(F.struct("place", "dist", "type", "kforce")).alias("r"))
    return first.select("model", "i", "j", "r.type", "r.kforce", "r.dist")


def placed(rules: DataFrame, n: int, models: int, keep: int, scale: float, steps: int = STEPS, stop: float | None = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(particles, headers) of the ``keep`` best models, each relaxed from the random start of its number on restraints of its own, one task a model."""

    def run(key, jobs, pdf):
        rows = list(pdf[["i", "j", "type", "kforce", "dist"]].sort_values(["i", "j"]).itertuples(index=False, name=None))
        x, value = relaxed(rows, n, int(key[0]), steps, stop=stop)
        x = x * scale
        return pd.DataFrame({"model": int(key[0]), "objfun": value, "particle": np.arange(n), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    spark = ship(rules).sparkSession
    jobs = spark.range(models).withColumnRenamed("id", "model")
    made = jobs.groupBy("model").cogroup(rules.groupBy("model")).applyInPandas(run, "model long, objfun double, particle long, x double, y double, z double")
    made = checkpointed(made)
    best = made.where("particle = 0").select("model", "objfun").orderBy("objfun", "model").limit(keep)
    return made.join(F.broadcast(best.select("model")), "model").drop("objfun"), best.select("model", F.col("model").alias("seed"), "objfun")


def parents(
    distributions: DataFrame, n: int, models: int, radius: float, scale: float, kforce: float = 5.0, seed: int = 1, apart: int = 1, steps: int = STEPS, **options
) -> DataFrame:
    """(model, a, b, d): distances of ``n`` parents at least ``apart`` from each other in the ``models`` best of twice as many coarse models.

    Models are numbered anew from 0, the best first.  ``radius`` is that of a parent; a share of 0.6 of the pairs is restrained.
    """
    rules = restraints(distributions, n, 2 * models, radius, scale, kforce, 0.6, seed, **options)
    particles, best = placed(rules, n, 2 * models, models, scale, steps)
    # One row a model.
    ranked = best.select("model", (F.row_number().over(Window.orderBy("objfun", "model")) - 1).cast("long").alias("place"))
    gaps = distances(particles).where(F.col("j") - F.col("i") >= apart).join(F.broadcast(ranked), "model")
    return gaps.select(F.col("place").alias("model"), F.col("i").alias("a"), F.col("j").alias("b"), "d")


def two_level(
    fine: DataFrame, coarse: DataFrame, n: int, ratio: int, models: int, keep: int, radius: float, scale: float,
    far: int = 0, kforce: float = 5.0, share: float = 0.3, seed: int = 1, empty: DataFrame | None = None, steps: int = STEPS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(restraints, particles, headers) of models of ``n`` particles whose parents, ``ratio`` particles each, are placed first.

    Parents hold pairs that are at least ``far`` particles apart.
    """
    size = -(-n // ratio)
    groups = fine.sparkSession.range(size).select(
        F.col("id").alias("group"), (F.col("id") * ratio).alias("first"), F.least((F.col("id") + 1) * ratio, F.lit(n)).alias("end")
    )
    above = parents(coarse, size, models, radius * ratio, scale, kforce, seed, max(1, -(-far // ratio)), steps)
    rules = restraints(fine, n, models, radius, scale, kforce, share, seed, empty, None, checkpointed(above), groups)
    rules = checkpointed(rules)
    particles, best = placed(rules, n, models, keep, scale, steps)
    return rules, particles, best
