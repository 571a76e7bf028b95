"""Restraints from z-scores, grids of parameters, and a simple model generator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactloom.shipping import ship


def restraints(
    z: DataFrame, n: int, radius: float, max_dist: float, upper: float, lower: float, k_near: float = 5.0
) -> DataFrame:
    """(i, j, type, kforce, dist) for particles 0 .. n - 1 from z-scores (i, j, z), i < j.

    Distances lie on the line through (least z, max_dist) and (largest z, 2 radius)
    over cells beyond the neighbours.  Neighbours: harmonic at the line if their z is
    above ``upper``, else an upper bound of two radii.  Second neighbours: an upper bound of
    four radii.  Others: harmonic above ``upper``, lower bound under ``lower``, with force
    sqrt(|z|); a missing z is the mean of the cells beside it with half the force.
    """
    return _rules(_filled(z, n), radius, F.lit(max_dist), F.lit(upper), F.lit(lower), k_near)


def _filled(z: DataFrame, n: int) -> DataFrame:
    """(i, j, z, guessed, z_low, z_high) of all pairs of particles."""
    ids = z.sparkSession.range(n)
    pairs = ids.toDF("i").join(ids.toDF("j"), F.col("i") < F.col("j"))
    beside = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    rows = pairs
    for k, (a, b) in enumerate(beside):
        rows = rows.join(z.select((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.col("z").alias(f"z{k}")), ["i", "j"], "left")
    around = F.array_compact(F.array(*[F.col(f"z{k}") for k in range(1, 5)]))
    mean = F.try_divide(F.aggregate(around, F.lit(0.0), lambda s, x: s + x), F.size(around).cast("double"))
    rows = rows.select("i", "j", F.coalesce("z0", mean).alias("z"), F.col("z0").isNull().alias("guessed"))
    line = z.where("j - i > 1").agg(F.min("z").alias("z_low"), F.max("z").alias("z_high"))
    return rows.crossJoin(F.broadcast(line))


def _rules(rows: DataFrame, radius: float, max_dist: Column, upper: Column, lower: Column, k_near: float, *keep: str) -> DataFrame:
    slope = F.try_divide(F.lit(2.0 * radius) - max_dist, F.col("z_high") - F.col("z_low"))
    at_line = F.greatest(F.lit(2.0 * radius), max_dist + slope * (F.col("z") - F.col("z_low")))
    gap = F.col("j") - F.col("i")
    kind = (
        F.when((gap == 1) & (F.col("z") > upper), "Harmonic")
        .when(gap == 1, "UpperBound")
        .when(gap == 2, "UpperBound")
        .when(F.col("z") > upper, "Harmonic")
        .when(F.col("z") < lower, "LowerBound")
    )
    dist = F.when((gap == 1) & (F.col("z") > upper), at_line).when(gap == 1, 2.0 * radius).when(gap == 2, 4.0 * radius).otherwise(at_line)
    force = F.when(gap <= 2, k_near).otherwise(F.sqrt(F.abs("z")) * F.when(F.col("guessed"), 0.5).otherwise(1.0))
    return rows.select(*keep, "i", "j", kind.alias("type"), force.alias("kforce"), dist.alias("dist")).where("type IS NOT NULL")


def grid(spark: SparkSession, **ranges: list) -> DataFrame:
    """One row per combination of the parameters' values."""
    df = spark.range(1).drop("id")
    for name, values in ranges.items():
        df = df.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))
    return df


def write_results(results: DataFrame, path: str) -> None:
    """Scores of a grid of parameters as tab-separated text, best first."""
    best = [c for c in results.columns if c == "corr"]
    results.orderBy(*[F.desc(c) for c in best]).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The scores of a grid again: all columns are numbers, and texts that are none are null."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in rows.columns])


def best_parameters(results: DataFrame, score: str = "corr") -> DataFrame:
    """The row with the best score."""
    rest = [c for c in results.columns if c != score]
    return results.agg(F.max_by(F.struct(*rest), score).alias("p"), F.max(score).alias(score)).select("p.*", score)


def relaxed(rows: list[tuple], n: int, seed: int, steps: int = 500, rate: float = 0.05, stop: float | None = None) -> tuple[np.ndarray, float]:
    """Coordinates and objective after gradient steps on the restraints from a seeded random start (not a physical simulation).

    With ``stop``, the steps end when the last 25 lowered the objective by less than that share of it, or of
    ``stop`` times the first objective: restraints that can all be met would else be followed to the last digit.
    """
    rng = np.random.default_rng(seed)
    i, j = (np.array([r[k] for r in rows], dtype=int) for k in (0, 1))
    k, d = (np.array([r[c] for r in rows], dtype=float) for c in (3, 4))
    kind = np.array([{"Harmonic": 0, "UpperBound": 1, "LowerBound": -1}[r[2]] for r in rows])
    x = rng.normal(0, d.mean() if len(d) else 1.0, (n, 3))

    def forces():
        v = x[i] - x[j]
        gap = np.sqrt((v * v).sum(axis=1)) + 1e-9
        off = gap - d
        off[(kind == 1) & (off < 0)] = 0
        off[(kind == -1) & (off > 0)] = 0
        return v, gap, off

    before = first = np.inf
    for step in range(steps):
        v, gap, off = forces()
        if stop is not None and step % 25 == 0:
            value = float((k * off * off).sum())
            first = value if step == 0 else first
            if before - value <= stop * max(value, stop * first):
                break
            before = value
        push = (rate * k * off / gap)[:, None] * v
        move = np.zeros_like(x)
        np.add.at(move, i, -push)
        np.add.at(move, j, push)
        degree = np.bincount(np.r_[i, j], np.r_[k, k], minlength=n)
        x = x + move / np.maximum(degree, 1.0)[:, None] * 4
    off = forces()[2]
    return x, float((k * off * off).sum())


def generate(rules: DataFrame, n: int, models: int, keep: int, steps: int = 500) -> tuple[DataFrame, DataFrame]:
    """(particles, headers) of the ``keep`` best of ``models`` models.  Seeds are dealt over tasks; a region's restraints go to each."""
    rows = [tuple(r) for r in rules.select("i", "j", "type", "kforce", "dist").orderBy("i", "j").collect()]

    def run(batches):
        for pdf in batches:
            for seed in pdf["id"]:
                x, value = relaxed(rows, n, int(seed), steps)
                yield pd.DataFrame({"seed": int(seed), "objfun": value, "particle": np.arange(n), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]})

    spark = ship(rules).sparkSession
    made = spark.range(models).mapInPandas(run, "seed long, objfun double, particle long, x double, y double, z double")
    best = made.select("seed", "objfun").distinct().orderBy("objfun", "seed").limit(keep)
    kept = made.join(F.broadcast(best.select("seed")), "seed")
    return kept.select(F.col("seed").alias("model"), "particle", "x", "y", "z"), best.select(F.col("seed").alias("model"), "seed", "objfun")


def search(z: DataFrame, n: int, settings: list[dict], cutoffs: list[float], radius: float, models: int, keep: int, steps: int = 500, stop: float = 1e-3, at_once: int = 4, k_near: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """(results, particles) of a search over sets of parameters for a region of ``n`` particles.

    ``settings`` have max_dist, upper and lower.  Every set makes ``models`` models, dealt over tasks by set
    and block of ``at_once`` seeds, each of which stops by itself when its objective no longer falls.  The
    ``keep`` best of a set give contact shares at every cutoff.  ``results``: (set, max_dist, upper, lower, cutoff, objfun, corr), where
    corr is Pearson's correlation of the shares with z over the pairs that have one, and objfun the kept
    models' mean; ``particles``: (set, model, particle, x, y, z), the kept models of all sets.
    A set without restraints places its particles at random; one whose shares do not vary has no corr.
    """
    from contactloom.operators.compare import known_corr
    from contactloom.operators.models3d import near_pairs
    from contactloom.operators.normalize import checkpointed

    spark = ship(z).sparkSession
    names = ("max_dist", "upper", "lower")
    sets = F.array(*[F.struct(F.lit(k).cast("long").alias("set"), *[F.lit(float(s[c])).alias(c) for c in names]) for k, s in enumerate(settings)])
    ids = F.array(*[F.lit(k).cast("long") for k in range(len(settings))])
    z = z.where(F.col("i").between(0, n - 1) & F.col("j").between(0, n - 1) & (F.col("i") < F.col("j")))
    each = _filled(z, n).withColumn("s", F.explode(sets)).select("i", "j", "z", "guessed", "z_low", "z_high", "s.*")
    rules = _rules(each, radius, F.col("max_dist"), F.col("upper"), F.col("lower"), k_near, "set")
    blocks = spark.range(-(-models // at_once)).select(F.explode(ids).alias("set"), F.col("id").alias("block"))

    def run(key, jobs, pdf):
        rows = list(pdf[["i", "j", "type", "kforce", "dist"]].sort_values(["i", "j"]).itertuples(index=False, name=None))
        out = []
        for block in sorted(jobs["block"]):
            for seed in range(int(block) * at_once, min(models, (int(block) + 1) * at_once)):
                x, value = relaxed(rows, n, seed, steps, stop=stop)
                out.append(pd.DataFrame({"set": key[0], "seed": seed, "objfun": value, "particle": np.arange(n), "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["set", "seed", "objfun", "particle", "x", "y", "z"])

    # A set's restraints go to each of its blocks of seeds.
    dealt = rules.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-(-models // at_once) - 1).cast("long"))))
    made = blocks.groupBy("set", "block").cogroup(dealt.groupBy("set", "block")).applyInPandas(run, "set long, seed long, objfun double, particle long, x double, y double, z double")
    made = checkpointed(made)
    heads = made.where("particle = 0").withColumn("place", F.row_number().over(Window.partitionBy("set").orderBy("objfun", "seed"))).where(F.col("place") <= keep)
    kept = made.join(heads.select("set", "seed"), ["set", "seed"], "left_semi").withColumn("model", F.col("set") * models + F.col("seed"))
    particles = kept.select("set", "model", "particle", "x", "y", "z")
    near = near_pairs(particles, max(cutoffs)).withColumn("set", F.floor(F.col("model") / models))
    near = near.withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs]))).where("d <= cutoff")
    near = near.groupBy("set", "cutoff", "i", "j").agg(F.count("*").alias("n"))
    wanted = z.select("i", "j", F.col("z").alias("v")).withColumn("set", F.explode(ids))
    wanted = wanted.withColumn("cutoff", F.explode(F.array(*[F.lit(float(c)) for c in cutoffs])))
    shares = wanted.join(near, ["set", "cutoff", "i", "j"], "left").withColumn("share", F.coalesce("n", F.lit(0)) / min(keep, models))
    scored = shares.groupBy("set", "cutoff").agg(known_corr(F.col("share"), F.col("v")).alias("corr"))
    means = heads.groupBy("set").agg(F.avg("objfun").alias("objfun"))
    given = spark.range(1).select(F.explode(sets).alias("s")).select("s.*")
    results = given.join(means, "set").join(scored, "set").select("set", *names, "cutoff", "objfun", "corr")
    return results, particles
