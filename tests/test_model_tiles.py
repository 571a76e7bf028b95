"""Work on all pairs of particles, dealt by tiles of two blocks, against plain versions."""

import itertools
import math
import random
import time
from collections import defaultdict

import numpy as np
import pytest

from contactloom.functions import geometry
from contactloom.operators import models3d

SCHEMA = "model long, particle long, x double, y double, z double"
N, CUTOFF = 150, 0.6


@pytest.fixture(scope="module")
def ensemble(spark):
    """Four models of particles with gaps in their numbers: several tiles; some rows are missing, without coordinates, or come twice."""
    rng, rows = random.Random(5), []
    for m, p in itertools.product(range(4), range(N)):
        x = None if rng.random() < 0.03 else rng.gauss(0, 1)
        if rng.random() > 0.05:
            rows.append((m, p * 1000 + p % 7, x, rng.gauss(0, 1), rng.gauss(0, 1)))
    rows += [(m, p, rng.gauss(0, 1), 0.0, 0.0) for m, p, *_ in rng.sample(rows, 5)] + [(None, 1, 0.0, 0.0, 0.0), (0, None, 0.0, 0.0, 0.0)]
    assert -(-N // models3d._tile_size(N)) > 2
    return rows, spark.createDataFrame(rows, SCHEMA).cache()


def pair_distances(rows):
    """{(model, i, j): [distance, ...]}; None where a coordinate is."""
    out, models = defaultdict(list), defaultdict(list)
    for r in rows:
        if r[0] is not None and r[1] is not None:
            models[r[0]].append(r)
    for m, of in models.items():
        for a, b in itertools.product(of, of):
            if a[1] < b[1]:
                out[m, a[1], b[1]].append(None if a[2] is None or b[2] is None else math.dist(a[2:], b[2:]))
    return out


def of_pairs(found, models=range(4)):
    out = defaultdict(list)
    for (m, i, j), d in found.items():
        if m in models:
            out[i, j] += d
    return out


def share(d):
    known = [x for x in d if x is not None]
    return sum(x <= CUTOFF for x in known) / len(known) if known else None


def test_shares_and_distances_equal_the_plain_ones(ensemble):
    rows, df = ensemble
    want = of_pairs(pair_distances(rows))
    assert {(r.i, r.j): r.share for r in models3d.contact_matrix(df, CUTOFF).collect()} == {k: share(d) for k, d in want.items()}
    near = {(r.i, r.j): r.share for r in models3d.contact_shares(df, CUTOFF).collect()}
    assert near == {k: share(d) for k, d in want.items() if share(d)} and near
    found = {(r.i, r.j): (r.mean, r.median) for r in models3d.distance_matrix(df).collect()}
    assert set(found) == set(want)
    for k, d in want.items():
        known = [x for x in d if x is not None]
        assert found[k] == ((pytest.approx(np.mean(known)), pytest.approx(np.median(known))) if known else (None, None))


def test_longest_distances_and_contacts_per_particle(ensemble):
    rows, df = ensemble
    plain = pair_distances(rows)
    each = {m: [x for (k, *_), d in plain.items() if k == m for x in d if x is not None] for m in range(4)}
    assert {r.model: (r.longest, r.shortest) for r in models3d.axes(df).collect()} == {m: (pytest.approx(max(d)), pytest.approx(min(d))) for m, d in each.items()}
    once = df.where("model is not null and particle is not null").dropDuplicates(["model", "particle"])
    single = pair_distances([tuple(r) for r in once.collect()])
    n = defaultdict(int)
    for (_, i, j), d in single.items():
        if d[0] is not None and d[0] <= CUTOFF:
            n[i], n[j] = n[i] + 1, n[j] + 1
    has = {r.particle: r["count"] for r in once.groupBy("particle").count().collect()}
    found = {r.particle: r.n for r in models3d.interactions(once, CUTOFF).collect()}
    assert found == {p: pytest.approx(n[p] / c) for p, c in has.items()}


def test_two_ensembles(ensemble):
    rows, df = ensemble
    plain = pair_distances(rows)
    a, b = of_pairs(plain, (0, 1)), of_pairs(plain, (2, 3))
    both = [(share(a[k]), share(b[k])) for k in a if k in b]
    both = np.array([p for p in both if None not in p])
    found = models3d.compare_ensembles(df.where("model < 2"), df.where("model > 1"), CUTOFF).first().corr
    assert found == pytest.approx(np.corrcoef(both.T)[0, 1])
    assert models3d.compare_ensembles(df.where("model < 2"), df.where("model < 2"), CUTOFF).first().corr == pytest.approx(1.0)


def test_pairs_are_not_shuffled(ensemble):
    """What is dealt grows with particles times blocks; no exchange has a row per pair of particles and model."""
    _, df = ensemble
    for found in (models3d.contact_matrix(df, CUTOFF), models3d.distance_matrix(df), models3d.contact_shares(df, CUTOFF)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(i#" not in plan and "hashpartitioning(low#" in plan
    clusters = df.where("model is not null").selectExpr("model", "model % 2 as cluster").distinct()
    for found in (models3d.deconvolved(df, clusters, CUTOFF), models3d.compare_ensembles(df.where("model < 2"), df.where("model > 1"), CUTOFF)):
        assert "hashpartitioning(i#" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_out_of_reach_are_not_compared(spark):
    """A straight chain of 1,000 particles: only blocks that touch meet, not all 136 pairs of them."""
    df = spark.createDataFrame([(0, p, float(p), 0.0, 0.0) for p in range(1000)], SCHEMA)
    blocked = df.selectExpr("0 as set", "*", f"cast(particle div {models3d._tile_size(1000)} as int) as block")
    assert models3d._boxes_within(blocked, 1.0).count() == 31
    assert models3d.contact_shares(df, 1.0).count() == 999
    assert models3d.contact_shares(df, -1.0).count() == 0


def test_particles_of_the_wanted_pairs(spark, ensemble):
    _, df = ensemble
    cells = df.where("particle < 20000").selectExpr("particle as i", "particle as j").distinct()
    near = models3d.among(df, cells)
    assert near.where("particle >= 20000").count() == 0
    want = models3d.contact_matrix(df, CUTOFF).where("j < 20000").collect()
    assert sorted(map(tuple, models3d.contact_matrix(near, CUTOFF).collect())) == sorted(map(tuple, want))


def plain_accessible(x, reach, points):
    out = []
    for i in range(len(x)):
        probe = x[i] + geometry.sphere_points(points) * reach
        d = np.sqrt(((probe[:, None] - np.delete(x, i, axis=0)[None]) ** 2).sum(axis=2))
        out.append((d >= reach - 1e-9).all(axis=1).mean() if d.size else 1.0)
    return np.array(out)


@pytest.mark.parametrize("radius,super_radius", [(0.1, 0.5), (0.3, 0.0), (0.01, 0.05), (5.0, 2.0)])
def test_accessible_surface(radius, super_radius):
    rng = np.random.default_rng(4)
    for x in (rng.normal(0, 0.4, (300, 3)), rng.uniform(-5, 5, (200, 3)), np.repeat(rng.normal(0, 1, (50, 3)), 3, axis=0), 1e6 + rng.normal(0, 1, (60, 3)), np.zeros((2, 3)), np.zeros((1, 3))):
        want = plain_accessible(x, radius + super_radius, 40)
        assert (geometry.accessible(x, radius, super_radius, 40) == want).all()
        own = np.arange(0, len(x), 3)
        assert (geometry.accessible(x, radius, super_radius, 40, own) == want[own]).all()


def test_accessible_surface_of_a_dense_model():
    """30,000 particles: all points against all particles would be 9e10 distances."""
    x = np.random.default_rng(1).normal(0, 0.2, (30_000, 3))
    start = time.process_time()
    found = geometry.accessible(x, 0.1, 0.5)
    assert time.process_time() - start < 60
    some = np.r_[np.argsort(-np.linalg.norm(x, axis=1))[:5], 0]
    probe = (x[some][:, None] + geometry.sphere_points() * 0.6)
    for k, p in zip(some, probe, strict=True):
        d = np.stack([np.linalg.norm(np.delete(x, k, axis=0) - q, axis=1).min() for q in p])
        assert found[k] == (d >= 0.6 - 1e-9).mean()


def test_models_with_many_particles_are_dealt(spark):
    """A model's particles go to several groups, so ten models keep more than ten tasks busy."""
    df = spark.createDataFrame([(0, p, float(p), 0.0, 0.0) for p in range(40)], SCHEMA)
    found = models3d.accessibility(df, 1.0, 1.0)
    assert found.count() == 40 and "part" in found._jdf.queryExecution().analyzed().toString()
