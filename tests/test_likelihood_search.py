"""The search for likelihood domains without a length limit."""

import numpy as np
import pytest

from contactloom.functions import segmentation as S
from contactloom.operators import segment
from tests.test_domain_callers import planted


def tables(spark, m, chrom="a"):
    i, j = np.nonzero(m)
    cells = spark.createDataFrame(list(zip(i.tolist(), j.tolist(), m[i, j].tolist(), strict=True)), "i long, j long, v double")
    return cells, spark.createDataFrame([(x, chrom, x) for x in range(len(m))], "bin long, chrom string, idx long")


def found(df):
    return [(r.start, r.end, None if r.score is None or r.score != r.score else r.score) for r in df.orderBy("start").collect()]


def test_fits_from_row_sums_equal_those_of_the_map():
    m = planted([9, 50, 30], 3)
    n, want = len(m), S.segment_likelihoods(m)
    up = np.triu(m, 1)
    logs = up * np.log(np.maximum(np.abs(np.subtract.outer(np.arange(n), np.arange(n))), 1))
    for first in (0, 7, 60, 84):
        ends = np.arange(first + 5, n + 1)
        part = lambda rows, cols: np.array([[up[r, c].sum(), logs[r, c].sum()] for r, c in zip(rows, cols, strict=True)])
        own = [slice(first, e) for e in ends]
        value = S.segment_fits(m.sum(axis=0), first, ends, part(own, own), part([slice(0, first)] * len(ends), own), part(own, [slice(e, n) for e in ends]), at_once=500)
        assert np.allclose(value, want[first, ends - 1 - first], rtol=1e-8, atol=1e-5)


def test_products_by_transform_equal_single_products():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 9, 70).astype(float), rng.integers(0, 9, 50).astype(float)
    both = np.r_[a, b]
    want = [sum(both[x] * both[x + d] for x in range(max(0, 70 - d), min(70, 120 - d))) for d in range(1, 120)]
    assert np.allclose(S.lag_products(a, b), want, atol=1e-8)
    assert np.allclose(S.own_products(a), [np.dot(a[:-d], a[d:]) for d in range(1, 70)], atol=1e-8)


def test_inner_totals_equal_sums_of_blocks():
    rng = np.random.default_rng(0)
    band = rng.random((7, 4))
    got = S.inner_totals(band)
    for p, h in ((0, 3), (2, 2), (3, 3), (6, 0)):
        assert np.isclose(got[p, h], sum(band[a, b - a] for a in range(p, p + h + 1) for b in range(a, p + h + 1)))


def test_coarse_to_fine_search_equals_the_exact_one(spark):
    m = planted([12, 30, 21, 9, 25, 13], 1)
    want = S.likelihood_domains([m])
    cells, bins = tables(spark, m)
    assert found(segment.domains_by_likelihood(cells, bins, parts=3)) == want
    coarse = found(segment.domains_by_likelihood(cells, bins, parts=3, width=16))
    assert [d[:2] for d in coarse] == [d[:2] for d in want]


def test_domains_longer_than_two_hundred_bins(spark):
    m = planted([230, 90, 260], 5, 60.0)
    cells, bins = tables(spark, m)
    got = found(segment.domains_by_likelihood(cells, bins, parts=4, width=40))
    # The exact search over all 168,000 segments (20 s on 8 cores) gives these ends too: the short pieces at both ends are the model's.
    assert [d[1] for d in got] == [4, 229, 319, 570, 579]


def test_odd_chromosomes(spark):
    cells = spark.createDataFrame([(0, 1, 2.0), (1, 0, 2.0)], "i long, j long, v double")
    bins = spark.createDataFrame([(0, "a", 0), (1, "a", 1), (2, "a", 2), (3, "b", 0)], "bin long, chrom string, idx long")
    assert found(segment.domains_by_likelihood(cells, bins)) == [(0, 2, None)]
    bad = spark.createDataFrame([(0, "x"), (1, "x")], "bin long, why string")
    assert found(segment.domains_by_likelihood(cells, bins, bad)) == [(0, 2, None)]
    assert found(segment.domains_by_likelihood(cells.where("false"), bins)) == []


def test_a_length_limit_without_a_solution_is_an_error():
    with pytest.raises(ValueError, match="too short"):
        S.best_path(np.array([0, 3]), np.array([5, 9]), np.ones(2), 9)
