"""The search over sets of modelling parameters, and the verb that returns the best set's models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.operators import restraints
from contactloom.plans import verbs

N, RADIUS = 14, 50.0
GOOD, EMPTY = {"max_dist": 400.0, "upper": 0.2, "lower": -0.2}, {"max_dist": 400.0, "upper": 99.0, "lower": -99.0}


@pytest.fixture
def z(spark):
    """z-scores that fall with the distance on a ring, so that the ends of the chain are neighbours."""
    at = np.c_[np.cos(np.arange(N) / N * 2 * np.pi), np.sin(np.arange(N) / N * 2 * np.pi)] * 230
    rows = [(i, j, float(1.5 - np.linalg.norm(at[i] - at[j]) / 150)) for i in range(N) for j in range(i + 1, N)]
    return spark.createDataFrame(rows, "i long, j long, z double")


def test_the_planted_set_is_found(z):
    results, particles = restraints.search(z, N, [EMPTY, GOOD], [120.0, 200.0], RADIUS, 6, 3, steps=300)
    best = restraints.best_parameters(results).first()
    assert best["set"] == 1 and best["corr"] > 0.6 and best["upper"] == GOOD["upper"]
    assert results.count() == 4 and particles.groupBy("set").agg(F.count_distinct("model").alias("n")).where("n = 3").count() == 2


def test_scores_equal_a_plain_search(z):
    results, particles = restraints.search(z, N, [GOOD, {**GOOD, "lower": -0.5}], [150.0], RADIUS, 5, 2, steps=80, at_once=2)
    got = {r["set"]: (r["objfun"], r["corr"]) for r in results.collect()}
    values = {(r.i, r.j): r.z for r in z.collect()}
    for k, s in enumerate([GOOD, {**GOOD, "lower": -0.5}]):
        rules = restraints.restraints(z, N, RADIUS, s["max_dist"], s["upper"], s["lower"]).orderBy("i", "j").collect()
        made = sorted(((restraints.relaxed([tuple(r) for r in rules], N, seed, 80, stop=1e-3)[::-1], seed) for seed in range(5)), key=lambda m: (m[0][0], m[1]))[:2]
        share = [np.mean([np.linalg.norm(x[i] - x[j]) <= 150 for (_, x), _ in made]) for i, j in values]
        assert abs(got[k][0] - np.mean([value for (value, _), _ in made])) < 1e-6 * abs(got[k][0])
        assert abs(got[k][1] - np.corrcoef(share, list(values.values()))[0, 1]) < 1e-9
    assert particles.where("set = 0").count() == 2 * N


def test_relaxation_stops_by_itself(z):
    rules = [tuple(r) for r in restraints.restraints(z, N, RADIUS, 400.0, 0.2, -0.2).orderBy("i", "j").collect()]
    at = lambda steps, stop=None: restraints.relaxed(rules, N, 1, steps, stop=stop)[1]
    early = at(100_000, 1e-3)
    # The same steps whatever their limit, and a rest that is small beside the start.
    assert at(10_000_000, 1e-3) == early == at(3000, 1e-3)
    assert early <= 1e-4 * at(0) and at(100, 1e-3) == at(100)


def test_a_map_without_contacts_and_sets_without_restraints(z):
    results, particles = restraints.search(z, N, [EMPTY], [1e-3], RADIUS, 2, 2, steps=5)
    assert [r.corr for r in results.collect()] == [None] and particles.count() == 2 * N
    results, particles = restraints.search(z.where("false"), 4, [GOOD], [10.0], RADIUS, 2, 1, steps=5)
    assert results.count() == 0 and particles.count() == 4


def test_the_model_verb_returns_the_best_set(spark, z):
    cells = z.select((F.col("i") + 5).alias("i"), (F.col("j") + 5).alias("j"), F.pow(F.lit(10.0), F.col("z")).alias("v"))
    cells = cells.unionByName(cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    results, best, particles = verbs.model(cells, 5, 5 + N, RADIUS, [EMPTY, GOOD], [120.0], 4, 2, steps=200)
    top = best.first()
    assert results.count() == 2 and top["corr"] == max(r.corr for r in results.collect() if r.corr is not None)
    assert particles.columns == ["model", "particle", "x", "y", "z"] and particles.count() == 2 * N
