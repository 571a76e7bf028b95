"""The command verbs as functions from tables to tables; with a catalogue a verb that has run is skipped by its caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.operators import badbins, compare, normalize, pairs, pixels, restraints, segment
from contactloom.sources import reads


def parse(ends: DataFrame, genome: DataFrame, enzyme: str) -> DataFrame:
    """Read ends with their restriction fragments."""
    return reads.with_fragment(ends, reads.fragments(genome, enzyme))


def filter_pairs(ends1: DataFrame, ends2: DataFrame, exclude=pairs.DEFAULT_EXCLUDE, **options) -> tuple[DataFrame, DataFrame]:
    """(valid pairs, all pairs with their classes)."""
    flagged = pairs.classify(pairs.intersect(ends1, ends2), **options)
    return pairs.apply_filter(flagged, exclude), flagged


def binned(valid: DataFrame, bins: DataFrame, resolution: int) -> DataFrame:
    """Half map of valid pairs: positions meet their bin by an equi-join on (chrom, idx)."""
    rows = valid.select("c1", "c2", F.floor(F.col("p1") / resolution).alias("x"), F.floor(F.col("p2") / resolution).alias("y"))
    place = bins.select("bin", "chrom", "idx")
    rows = rows.groupBy("c1", "c2", "x", "y").count()
    rows = rows.join(place.toDF("a", "c1", "x"), ["c1", "x"]).join(place.toDF("b", "c2", "y"), ["c2", "y"])
    return rows.groupBy(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum("count").alias("v"))


def normalise(half: DataFrame, bins: DataFrame, method: str = "vanilla", min_count: float = 0, factor: float = 1.0, **options) -> dict[str, DataFrame]:
    """bad, bias and decay tables of a half map; method vanilla, sqrt, ice, or oned with ``covariates``."""
    full = pixels.symmetric(half)
    bad = badbins.by_min_count(full, bins, min_count)
    good = pixels.good(full, bad)
    additive = lambda cells, covariates, **more: normalize.one_d(normalize.row_sums(cells), covariates, **more)
    how = {"vanilla": normalize.vanilla, "sqrt": normalize.square_root, "ice": normalize.iterative, "oned": additive}[method]
    bias = normalize.rescaled(good, how(good, **options), bins.count(), factor)
    return {"bad": bad, "bias": bias, "decay": normalize.decay(full, bins, bias, bad)}


def region(half: DataFrame, bins: DataFrame, tables: dict[str, DataFrame], ranges, kind: str = "norm") -> DataFrame:
    """raw, norm or decay values of a region."""
    cells = pixels.crop(pixels.symmetric(half), ranges, shift=False)
    if kind == "raw":
        return cells
    cells = pixels.good(cells, tables["bad"])
    return pixels.normalized(cells, tables["bias"]) if kind == "norm" else pixels.decayed(cells, tables["bias"], bins, tables["decay"])


def merge(first: DataFrame, second: DataFrame, bins: DataFrame, max_dist: int = 10) -> tuple[DataFrame, DataFrame]:
    """(sum of two half maps, their correlation per distance)."""
    cells = compare.aligned_diagonals(first, second, bins, max_dist)
    return pixels.add(first, second), compare.by_distance(cells)


def segments(half: DataFrame, bins: DataFrame, tables: dict[str, DataFrame], rich_in_a: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(compartments, domains) of a map."""
    full = pixels.good(pixels.symmetric(half), tables["bad"])
    return segment.compartments(pixels.normalized(full, tables["bias"]), bins, tables["decay"], rich_in_a), segment.domains_by_likelihood(full, bins, tables["bad"])


def model(cells: DataFrame, first: int, end: int, radius: float, settings: list[dict], cutoffs: list[float], models: int, keep: int, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, best, particles) of a region's bins first .. end - 1: all parameter sets, the best one, and its kept models."""
    z = pixels.zscores(pixels.crop(cells, (first, end, first, end))).where("i < j")
    results, particles = restraints.search(z, end - first, settings, cutoffs, radius, models, keep, **options)
    results = normalize.checkpointed(results)
    best = restraints.best_parameters(results.where("corr is not null"))
    return results, best, particles.join(best.select("set"), "set", "left_semi").drop("set")
