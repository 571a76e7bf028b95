import numpy as np
import pytest

from contactloom.operators import badbins, compare, normalize, pixels, segment, stats
from contactloom.plans import verbs


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(5)
    n = 24
    d = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    m = rng.poisson(200.0 / (d + 1)) + 1
    return np.triu(m) + np.triu(m, 1).T


@pytest.fixture(scope="module")
def cells(spark, dense):
    return spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(dense)], "i long, j long, v double").cache()


@pytest.fixture(scope="module")
def bins(spark):
    chroms = spark.createDataFrame([("c1", 0, 1199), ("c2", 1, 1199)], "chrom string, ord int, length long")
    return pixels.bins_of(chroms, 100).cache()


def as_dict(df, *names):
    return {tuple(r)[:-1] if len(names) != 2 else r[0]: r[-1] for r in df.select(*names).collect()}


def test_bins_have_one_more_than_the_quotient(bins):
    rows = bins.orderBy("bin").collect()
    assert len(rows) == 24 and [r.idx for r in rows] == list(range(12)) * 2 and rows[12].chrom == "c2"


def test_pixels_double_the_diagonal(spark):
    half = spark.createDataFrame([(0, 0, 3), (0, 1, 2)], "i long, j long, v long")
    assert sorted(map(tuple, pixels.symmetric(half).collect())) == [(0, 0, 6), (0, 1, 2), (1, 0, 2)]


def test_rebin_keeps_the_sum(cells, dense):
    assert pixels.rebin(cells, 4).agg({"v": "sum"}).first()[0] == dense.sum()
    with pytest.raises(ValueError):
        pixels.rebin(cells, 1.5)


def test_iterative_balancing_agrees_with_numpy(cells, dense):
    w, b, mean = dense.astype(float), np.ones(len(dense)), 1.0
    for _ in range(11):
        s = w.sum(axis=1)
        mean = s.mean()
        if max(abs(s.min() / mean - 1), abs(s.max() / mean - 1)) < 1e-5:
            b *= s / mean
            break
        b *= s / mean
        w = dense / np.outer(b, b)
    found = as_dict(normalize.iterative(cells, iterations=10), "bin", "b")
    np.testing.assert_allclose([found[k] for k in range(len(b))], b * np.sqrt(mean), rtol=1e-9)


def test_vanilla_is_one_round(cells, dense):
    s = dense.sum(axis=1)
    found = as_dict(normalize.vanilla(cells), "bin", "b")
    np.testing.assert_allclose([found[k] for k in range(len(s))], s / s.mean() * np.sqrt(s.mean()))
    again = as_dict(normalize.iterative(cells), "bin", "b")
    np.testing.assert_allclose([again[k] for k in range(len(s))], [found[k] for k in range(len(s))])


def test_rescaling_sets_the_mean(cells, dense):
    bias = normalize.rescaled(cells, normalize.vanilla(cells), len(dense), 2.0)
    total = pixels.total(cells, bias=bias).first()[0]
    assert total / dense.size == pytest.approx(2.0)


def test_decay_pools_until_the_minimum(spark, bins):
    rows = [(k, 0, v) for k, v in enumerate([500.0, 300.0, 200.0, 50.0, 10.0])]
    found = as_dict(normalize.decay(spark.createDataFrame(rows, "i long, j long, v double"), bins), "chrom", "dist", "expected")
    assert found[("c1", 0)] == pytest.approx(500 / 12)
    assert found[("c1", 1)] == found[("c1", 2)] == pytest.approx(500 / 21)
    rest = sum(12 - k for k in range(3, 12))
    assert found[("c1", 5)] == pytest.approx((500 + 60) / (21 + rest))
    assert ("c2", 0) not in found


def test_decay_leaves_out_cells_of_bad_bins(spark, bins):
    bad = spark.createDataFrame([(2, "x"), (5, "x")], "bin long, why string")
    found = as_dict(normalize.distance_cells(bins, bad), "chrom", "dist", "cells")
    good = [k for k in range(12) if k not in (2, 5)]
    for d in range(12):
        assert found[("c1", d)] == sum(a - b == d for a in good for b in good)
        assert found[("c2", d)] == 12 - d


def test_focus_grammar():
    sections = {"a": (0, 10), "b": (10, 30)}
    assert pixels.focus("b", sections, 100) == (10, 30, 10, 30)
    assert pixels.focus("a:200-500", sections, 100) == (2, 5, 2, 5)
    assert pixels.focus(("a", "b:0-300"), sections, 100) == (0, 10, 10, 13)
    assert pixels.focus((3, 5), sections, 100) == (2, 5, 2, 5)
    assert pixels.focus((1, 2, 3, 4), sections, 100) == (0, 2, 2, 4)
    for wrong in ("x", "a:900-2000", (1, 2, 3)):
        with pytest.raises(ValueError):
            pixels.focus(wrong, sections, 100)


def test_division_by_nothing_is_null(spark):
    a = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0)], "i long, j long, v double")
    b = spark.createDataFrame([(0, 0, 2.0), (1, 1, 5.0)], "i long, j long, v double")
    assert as_dict(pixels.divide(a, b), "i", "j", "v") == {(0, 0): 2.0, (0, 1): None, (1, 1): 0.0}


def test_bad_bins(spark, cells, bins):
    few = cells.where("i <> 3 AND j <> 3")
    assert {r[0] for r in badbins.by_zero_count(few, bins, 24, 50).collect()} == {3}
    assert {r[0] for r in badbins.by_min_count(few, bins, 1).collect()} == {3}
    rows = badbins.runs(spark.createDataFrame([(3, "x"), (4, "x"), (12, "x")], "bin long, why string"), bins).collect()
    assert sorted((r.chrom, r["first"], r["last"], r.n) for r in rows) == [("c1", 3, 4, 2), ("c2", 0, 0, 1)]


def test_insulation_is_the_square_sum(cells, dense, bins):
    found = as_dict(segment.insulation(cells, bins, 1, 3), "chrom", "idx", "score")
    assert set(found) == {(c, x) for c in ("c1", "c2") for x in range(3, 9)}
    for (c, x), v in found.items():
        o = 0 if c == "c1" else 12
        assert v == dense[o + x - 3 : o + x, o + x + 1 : o + x + 4].sum()


def test_correlations_per_distance(spark, cells, dense, bins):
    other = spark.createDataFrame([(int(i), int(j), float(v + (i * j) % 5)) for (i, j), v in np.ndenumerate(dense)], "i long, j long, v double")
    rows = {r.dist: r for r in compare.by_distance(compare.aligned_diagonals(cells, other, bins, 3)).collect()}
    a = np.concatenate([np.diagonal(dense[o : o + 12, o : o + 12], 2) for o in (0, 12)])
    b = np.concatenate([[v + (i * (i + 2)) % 5 for i, v in enumerate(np.diagonal(dense[o : o + 12, o : o + 12], 2), o)] for o in (0, 12)])
    assert rows[2].pearson == pytest.approx(np.corrcoef(a, b)[0, 1]) and rows[2].n == 20
    assert compare.stratum_adjusted(compare.aligned_diagonals(cells, cells, bins, 3)).first().scc == pytest.approx(1)
    assert all(r.score == pytest.approx(1) for r in compare.reproducibility(cells, cells, bins, 4, 0.0).collect())


def test_strand_shares_sum_to_one(spark):
    rows = [("c", 10, 1, "c", 30, 0), ("c", 50, 1, "c", 20, 1), ("c", 1, 0, "c", 15, 1)]
    df = spark.createDataFrame(rows, "c1 string, p1 long, s1 int, c2 string, p2 long, s2 int")
    for r in stats.strand_bias(df, 100, 1000).collect():
        assert r.plus + r.minus + r.facing + r.away == pytest.approx(1)


def test_normalise_verb_and_regions(cells, bins):
    half = cells.where("i <= j").withColumn("v", cells["v"].cast("long"))
    tables = verbs.normalise(half, bins, "ice", iterations=3)
    for kind in ("raw", "norm", "decay"):
        assert verbs.region(half, bins, tables, (0, 12, 0, 12), kind).count() == 144


def test_shuffled_diagonals_keep_their_values(cells, dense, bins):
    from collections import Counter

    rows = pixels.randomized(cells, bins).collect()
    assert len(rows) == 2 * 12 * 13 // 2
    found, want = Counter(), Counter()
    for r in rows:
        found[(r.i // 12, r.j - r.i, r.v)] += 1
    for o in (0, 12):
        for i in range(12):
            for j in range(i, 12):
                want[(o // 12, j - i, float(dense[o + i, o + j]))] += 1
    assert found == want
    assert any(r.v != dense[r.i, r.j] for r in rows)


def test_structure_score_of_blocks(spark, bins):
    m = np.where(np.arange(24)[:, None] // 6 == np.arange(24)[None, :] // 6, 50.0, 5.0)
    blocks = spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")
    flat = spark.createDataFrame([(i, j, 5.0) for i in range(24) for j in range(24)], "i long, j long, v double")
    assert min(r.excess for r in compare.structure_score(blocks, bins).collect()) > 0.05
    assert max(r.excess for r in compare.structure_score(flat, bins).collect()) < 1e-6


def test_region_tables(spark, cells):
    bias = spark.createDataFrame([(k, float(k)) for k in range(6)], "bin long, b double")
    assert sorted(map(tuple, pixels.bias_region(bias, 2, 4).collect())) == [(0, 2.0), (1, 3.0)]
    assert pixels.region_name("c1", 5, 9, "c2") == "c1:5-9_c2"
    high = pixels.binary_contacts(cells)
    middle = np.median([r.v for r in cells.where("i < j").collect()])
    assert high.count() == cells.where(f"i < j AND v > {middle}").count()
