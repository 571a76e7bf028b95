import itertools
import math
import time

import numpy as np
import pytest

from contactloom.functions import segmentation as S
from contactloom.operators import segment


def planted(sizes, seed=0, depth=40.0):
    """A map of domains of the given sizes over a decaying background."""
    rng, n = np.random.default_rng(seed), sum(sizes)
    label = np.repeat(np.arange(len(sizes)), sizes)
    d = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    mean = depth * (d + 1.0) ** -1 * np.where(label[:, None] == label[None, :], 4.0, 0.5)
    m = np.triu(rng.poisson(mean))
    return (m + np.triu(m, 1).T).astype(float)


def plain_likelihood(k, w, logd):
    """The fitted Poisson log-likelihood of single cells, by a fine search over the slope (the level has a closed form)."""
    if not len(k) or k.sum() == 0:
        return 0.0
    at = lambda b: (lambda a: float((k * (a + b * logd)).sum() - k.sum()))(math.log(k.sum() / (w * np.exp(b * logd)).sum()))
    low, high = -30.0, 30.0
    for _ in range(200):
        p, q = low + (high - low) / 3, high - (high - low) / 3
        low, high = (p, high) if at(p) < at(q) else (low, q)
    return at((low + high) / 2)


def test_segment_likelihoods_equal_a_fit_of_single_cells():
    m = planted([6, 5, 7], 3)
    n, sums = len(m), m.sum(axis=0)
    w, d = np.outer(sums, sums), np.log(np.maximum(np.abs(np.subtract.outer(np.arange(n), np.arange(n))), 1))
    ll = S.segment_likelihoods(m)
    for i, j in itertools.combinations(range(n), 2):
        if j - i + 1 < 5:
            assert ll[i, j - i] == -np.inf
            continue
        own = np.triu_indices(j - i + 1, 1)
        b = slice(i, j + 1)
        want = plain_likelihood(m[b, b][own], w[b, b][own], d[b, b][own])
        for other in (slice(0, i), slice(j + 1, n)):
            want += 0.5 * plain_likelihood(m[other, b].ravel(), w[other, b].ravel(), d[other, b].ravel())
        assert ll[i, j - i] == pytest.approx(want, abs=1e-3)
    assert np.isclose(S.segment_likelihoods(m, longest=8, starts=[3])[3, 5], ll[3, 5])


def test_optimal_breaks_equal_a_search_of_all_segmentations():
    rng = np.random.default_rng(5)
    for longest in (5, 9):
        n = 9
        ll = np.where(np.arange(longest)[None, :] + np.arange(n)[:, None] < n, rng.normal(0, 30, (n, longest)), -np.inf)
        best, ends = -np.inf, None
        for nb in range(0, n // 5 + 2):
            for cut in itertools.combinations(range(n - 1), nb):
                parts = list(zip([0, *(c + 1 for c in cut)], [*cut, n - 1], strict=True))
                if all(e - s < longest for s, e in parts):
                    value = sum(ll[s, e - s] for s, e in parts) - (nb + 8 + 6 * nb)
                    if value > best:
                        best, ends = value, [e for _, e in parts]
        assert S.optimal_breaks(ll, most=n // 5 + 1) == ends


def test_planted_domains_are_found_by_both_callers():
    sizes = [20, 25, 15, 30]
    m, want = planted(sizes, 1), np.cumsum(sizes)[:-1] - 1
    found = [e for _, e, _ in S.likelihood_domains([m])][:-1]
    assert len(found) == len(want) and all(min(abs(found - w)) <= 1 for w in want)
    assert {s for _, _, s in S.likelihood_domains([m])[:-1]} <= set(map(float, range(11)))
    ends = np.array([e for _, e, kind, _ in S.window_domains(m, 5) if kind == "domain"])
    assert all(min(abs(ends - w)) <= 1 for w in want)


def test_a_chromosome_of_real_size_is_segmented_in_time(spark):
    """1,601 bins; a sixteenth of the segments is timed, the best segments are found on all of them by a stand-in."""
    m = planted([64] * 25 + [1], 2, 5.0)
    start = time.process_time()
    ll = S.segment_likelihoods(m, longest=60, starts=range(0, len(m), 100))
    assert time.process_time() - start < 60 and np.isfinite(ll[0, 4:]).all()
    start = time.process_time()
    S.scored_breaks(np.random.default_rng(1).normal(0, 50, (1601, 60)))
    assert time.process_time() - start < 240


def test_tasks_agree_with_one_map(spark):
    m = planted([12, 14, 10], 4)
    rows = [("a", i, j, float(m[i, j])) for i in range(36) for j in range(36) if m[i, j]]
    bins = spark.createDataFrame([(i, "a", i) for i in range(36)] + [(36 + i, "b", i) for i in range(3)], "bin long, chrom string, idx long")
    cells = spark.createDataFrame([(i, j, v) for _, i, j, v in rows] + [(36, 37, 2.0), (37, 36, 2.0)], "i long, j long, v double")
    found = segment.domains_by_likelihood(cells, bins, longest=36, parts=5).orderBy("chrom", "start").collect()
    want = [("a", *d) for d in S.likelihood_domains([m])] + [("b", 0, 2, None)]
    assert [(r.chrom, r.start, r.end, None if r.score is None or r.score != r.score else r.score) for r in found] == want
    bad = spark.createDataFrame([(5, "x")], "bin long, why string")
    removed = np.zeros(36, dtype=bool)
    removed[5] = True
    found = segment.domains_by_likelihood(cells, bins, bad, longest=36, parts=3).where("chrom = 'a'").orderBy("start").collect()
    assert [(r.start, r.end) for r in found] == [d[:2] for d in S.likelihood_domains([m], removed)]


def plain_cuts(x):
    """Greedy chords from the definition with plain geometry."""
    y = [v / np.abs(np.diff(x)).mean() for v in x]
    gone = lambda i, j, k: abs((j - i) * (y[k] - y[i]) - (y[j] - y[i]) * (k - i)) / math.hypot(j - i, y[j] - y[i])
    merit = lambda i, j: math.hypot(j - i, y[j] - y[i]) - sum(gone(i, j, k) for k in range(i + 1, j))
    cuts = [0]
    while cuts[-1] < len(x) - 1:
        i = cuts[-1]
        j = i + 1
        while j < len(x) - 1 and merit(i, j + 1) >= merit(i, j):
            j += 1
        cuts.append(j)
    return cuts


def test_cuts_and_extremes_of_curves():
    rng = np.random.default_rng(8)
    for _ in range(30):
        x = rng.normal(0, 1, 25).cumsum()
        y = x / np.abs(np.diff(x)).mean()
        assert S._bends(np.arange(25) + 1j * y) == plain_cuts(x)
    # An extreme inside a stretch whose neighbours are cuts: the curve falls in small steps and rises at once.
    low, high = S.turning_points(np.array([9, 5, 2, 1, 0.5, 7, 8, 9, 3, 2, 1, 4, 8.0]))
    assert 4 in low and 7 in high and 10 in low
    assert S.turning_points(np.array([3.0, 1.0, 2.0])) == ([1], [0]) and S.turning_points(np.array([])) == ([], [])


def test_gaps_are_runs_without_contacts_among_themselves():
    m = np.zeros((10, 10))
    m[0, 1] = m[1, 0] = m[1, 2] = m[2, 1] = m[7, 8] = m[8, 7] = m[2, 6] = m[6, 2] = 1
    m[9, 9] = 5
    want = np.zeros(10, dtype=bool)
    a = 0
    while a < 10:
        b = a + 1
        while b < 10 and m[a : b + 1, a : b + 1].sum() == 0:
            b += 1
        want[a:b] = b - a > 1
        a = b
    assert S.gap_bins(m).tolist() == want.tolist()
    assert not S.gap_bins(np.eye(4)).any() and S.gap_bins(np.zeros((4, 4))).all()


def test_rows_tile_the_chromosome_and_gaps_are_named():
    m = planted([15, 18], 6)
    m = np.pad(m, ((0, 6), (0, 6)))
    found = S.window_domains(m, 4)
    assert (33, 38, "gap", 0.0) in found
    covered = sorted((a, b) for a, b, kind, _ in found)
    assert covered[0][0] == 0 and covered[-1][1] == 38 and all(0 <= p <= 1 for *_, p in found)
