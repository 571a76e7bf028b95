"""Restraints drawn from distributions of distances, and models in two resolutions."""

import hashlib
import math

import numpy as np
import pytest

from contactloom.operators import probable

PAIRS = "i long, j long, k double, loc double, width double"
N, MODELS, RADIUS, SCALE = 12, 4, 0.5, 2.0


def uniform(seed, tag, model, i, j, part):
    h = hashlib.sha256(f"{seed}{tag}:{model}:{i}:{j}".encode()).hexdigest()
    return (int(h[13 * part : 13 * part + 13], 16) + 0.5) / 2**52


def draw(seed, model, i, j, k, loc, width):
    u = [uniform(seed, "", model, i, j, p) for p in range(3)]
    return loc + width * (math.sqrt(-2 * math.log(u[0])) * math.cos(2 * math.pi * u[1]) - k * math.log(u[2]))


def table(n=N, left_out=(), unknown=()):
    """Distributions of all pairs but some; unknown ones are below the floor."""
    rows = []
    for i in range(n):
        for j in range(i + 1, n):
            if (i, j) not in left_out:
                loc = 3.0 + 1.5 * math.sqrt(j - i) + (i * 7 + j * 3) % 5 / 10
                rows.append((i, j, 0.3 + (i + j) % 4 * 0.5, loc, 0.1 if (i, j) in unknown else 0.4))
    return rows


def plain(rows, n, share=0.3, seed=1, empty=(), parents=(), groups=(), kforce=5.0):
    """The restraints pair by pair."""
    good = {(i, j): (min(max(k, 0.5), 1.5), loc, w) for i, j, k, loc, w in rows if loc >= 0.2 and w >= 0.2}
    top = max(loc for _, loc, _ in good.values())
    weight = {p: top / 4 / SCALE if loc > 0.75 * top else ((top - loc + 1) / SCALE) ** 2 for p, (_, loc, _) in good.items()}
    dist = {(m, *p): draw(seed, m, *p, *good[p]) for m in range(MODELS) for p in good}
    reach, mid = {}, {}
    for g in {j - i for i, j in good}:
        same = [p for p in good if p[1] - p[0] == g]
        reach[g] = np.median([np.percentile([dist[m, *p] for m in range(MODELS)], 90) for p in same])
        mid[g] = np.median([weight[p] for p in same])
    close = max(np.median([dist[m, *p] for p in good if p[1] - p[0] == 1]) for m in range(MODELS))
    runs, loose = [], {p[:2] for p in rows if p[:2] not in good and p[1] - p[0] > 1}
    for b in sorted(empty):
        if runs and runs[-1][-1] == b - 1:
            runs[-1].append(b)
        else:
            runs.append([b])
    loose |= {(a, b) for r in runs for a in r for b in r if b - a > 1}
    out = {}
    for m in range(MODELS):
        for (i, j), w in weight.items():
            if j - i == 1:
                out[m, i, j] = ("Harmonic", kforce * w, max(dist[m, i, j] / SCALE, 0))
        order = sorted((uniform(seed, "", m, i, j, 3), i, j) for i, j in good if j - i > 1)
        kept = []
        for u, i, j in order:
            if u < share and not any((low, i) in kept and (low, j) in kept for low in range(n)):
                kept.append((i, j))
                out[m, i, j] = ("Harmonic", kforce * weight[i, j], max(dist[m, i, j] / SCALE, 2 * RADIUS))
        for i in range(n - 1):
            if (i, i + 1) not in good:
                out[m, i, i + 1] = ("UpperBound", 10 * kforce * mid[1], max(close / SCALE, 2 * RADIUS))
        for i, j in loose:
            if uniform(seed, "e", m, i, j, 0) < share and j - i in reach:
                out.setdefault((m, i, j), ("UpperBound", kforce * mid[j - i], reach[j - i] / SCALE))
        far = {}
        for model, a, b, d in parents:
            if model == m and uniform(seed, "f", m, a, b, 0) < 2 * share:
                sides = []
                for part, g in ((1, a), (2, b)):
                    inside = [x for x in range(*groups[g]) if x not in empty]
                    sides.append(inside[int(uniform(seed, "f", m, a, b, part) * len(inside))] if inside else None)
                if None not in sides and sides[0] != sides[1]:
                    p = tuple(sorted(sides))
                    far[p] = min(far.get(p, math.inf), d / SCALE)
        for p, d in far.items():
            out.setdefault((m, *p), ("Harmonic", kforce * top / 4 / SCALE, d))
    return out


def same(got, want):
    got = {(r.model, r.i, r.j): (r.type, r.kforce, r.dist) for r in got.collect()}
    assert got.keys() == want.keys()
    for key, (kind, force, dist) in want.items():
        assert got[key][0] == kind and got[key][1:] == pytest.approx((force, dist), rel=1e-9), key


def test_draws_equal_a_plain_draw_by_seed(spark):
    rows = table(6)
    pairs = probable.known(spark.createDataFrame(rows, PAIRS)).where("known")
    for parts in (1, 5):
        got = {(r.model, r.i, r.j): r.dist for r in probable.drawn(pairs.repartition(parts), 3, 9).collect()}
        assert len(got) == 45
        for i, j, k, loc, w in rows:
            for m in range(3):
                assert got[m, i, j] == pytest.approx(draw(9, m, i, j, min(max(k, 0.5), 1.5), loc, w), abs=1e-9)


def test_fitted_finds_planted_distributions(spark):
    pairs = spark.createDataFrame([(0, 1, 1.0, 50.0, 4.0), (0, 2, 0.7, 90.0, 6.0)], PAIRS)
    dists = probable.drawn(pairs, 6000, 3).select("model", "j", "dist").toPandas()
    assert dists.groupby("j")["dist"].mean().tolist() == pytest.approx([54.0, 94.2], abs=0.5)
    # Particle 0 at the origin, the others on two axes at their draws.
    rows = [(int(m), int(j), d if j == 1 else 0.0, d if j == 2 else 0.0, 0.0) for m, j, d in dists.itertuples(index=False)]
    rows += [(m, 0, 0.0, 0.0, 0.0) for m in range(6000)] + [(0, 3, None, 0.0, 0.0)]
    found = {(r.i, r.j): r for r in probable.fitted(spark.createDataFrame(rows, "model long, particle long, x double, y double, z double"), 2).collect()}
    assert found.keys() == {(0, 1), (0, 2), (1, 2)}
    for (j, k, loc, width) in ((1, 1.0, 50.0, 4.0), (2, 0.7, 90.0, 6.0)):
        r = found[0, j]
        assert abs(r.k - k) < 0.25 and abs(r.loc - loc) < 1.2 and abs(r.width - width) < 0.7


def test_restraints_equal_a_plain_version(spark):
    rows = table(left_out={(4, 5), (2, 9), (7, 8)}, unknown={(0, 3), (1, 6)})
    parents = [(m, a, b, 10.0 + m + a + b) for m in range(MODELS) for a in range(3) for b in range(a + 1, 3)]
    groups = {0: (0, 4), 1: (4, 8), 2: (8, 12)}
    for share in (0.3, 0.9):
        got = probable.restraints(
            spark.createDataFrame(rows, PAIRS), N, MODELS, RADIUS, SCALE, share=share, seed=5,
            empty=spark.createDataFrame([(7,), (8,), (9,), (11,), (9,)], "bin long"),
            parents=spark.createDataFrame(parents, "model long, a long, b long, d double"),
            groups=spark.createDataFrame([(g, *r) for g, r in groups.items()], "group long, first long, end long"),
        )
        same(got, plain(rows, N, share, 5, {7, 8, 9, 11}, parents, groups))


def test_odd_tables(spark):
    none = spark.createDataFrame([], PAIRS)
    got = probable.restraints(none, 4, 2, RADIUS, SCALE, chains=[2, 2]).orderBy("model", "i").collect()
    # Only the bounds between neighbours of one chain.
    assert [(r.model, r.i, r.j, r.type, r.dist) for r in got] == [(m, i, i + 1, "UpperBound", 1.0) for m in (0, 1) for i in (0, 2)]
    rows = table(4) + table(4)[:2] + [(0, 1, None, 99.0, 1.0), (1, 3, float("nan"), 99.0, 1.0), (2, 9, 1.0, 5.0, 1.0), (3, 2, 1.0, 5.0, 1.0)]
    same(probable.restraints(spark.createDataFrame(rows, PAIRS), 4, MODELS, RADIUS, SCALE), plain(table(4), 4))
    assert probable.restraints(none, 1, 2, RADIUS, SCALE).count() == 0
    particles, best = probable.placed(probable.restraints(none, 1, 2, RADIUS, SCALE), 1, 2, 2, SCALE)
    assert particles.count() == 2 and best.count() == 2


def test_unlike_thinning_keeps_no_third_side():
    assert probable.independent([(0, 4), (0, 7), (4, 7), (2, 4), (2, 7), (0, 2)]) == [True, True, False, True, True, True]
    assert probable.independent([(4, 7), (0, 4), (0, 7)]) == [True, True, True] and probable.independent([]) == []


def test_models_follow_planted_distances_in_both_resolutions(spark):
    n, ratio = 24, 4
    at = np.c_[np.cos(np.arange(n) / n * 5), np.sin(np.arange(n) / n * 5), np.arange(n) / 12] * 300
    gap = lambda x, i, j: float(np.linalg.norm(x[i] - x[j]))
    fine = [(i, j, 0.5, gap(at, i, j), 5.0) for i in range(n) for j in range(i + 1, n) if j - i <= 8]
    centre = at.reshape(-1, ratio, 3).mean(axis=1)
    coarse = [(i, j, 0.5, gap(centre, i, j), 5.0) for i in range(6) for j in range(i + 1, 6)]
    fine, coarse = (spark.createDataFrame(r, PAIRS) for r in (fine, coarse))
    rules, particles, best = probable.two_level(fine, coarse, n, ratio, 6, 3, 0.2, 50.0, far=8)
    assert best.count() == 3 and particles.groupBy("model").count().where(f"count = {n}").count() == 3
    far = rules.where("j - i > 8")
    assert far.count() > 0 and rules.where("model >= 6").count() == 0
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    for _, m in particles.toPandas().sort_values("particle").groupby("model"):
        x = m[["x", "y", "z"]].to_numpy()
        assert np.corrcoef([gap(x, *p) for p in pairs], [gap(at, *p) for p in pairs])[0, 1] > 0.85
