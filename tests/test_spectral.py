"""Eigenvectors by Krylov iteration against dense ones."""

import numpy as np
import pytest

from contactloom.functions.linear import correlation, eigenvectors, normalized_laplacian
from contactloom.operators import spectral


def maps(sizes, seed=3, empty=(4, 5)):
    rng = np.random.default_rng(seed)
    out = {}
    for c, n in sizes.items():
        m = rng.gamma(1.0, 1.0, (n, n)) * (rng.random((n, n)) < 0.4)
        half = np.sign(np.sin(np.arange(n) / 3 + 0.2))
        m = m + m.T + np.clip(2 + 2 * np.outer(half, half), 0, None) + np.diag(np.arange(n) / n)
        for e in empty:
            if e < n:
                m[e] = m[:, e] = 0
        out[c] = m
    return out


def cells_of(spark, made):
    rows = [(c, i, j, float(m[i, j])) for c, m in made.items() for i, j in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame([(c, int(i), int(j), v) for c, i, j, v in rows], "chrom string, i long, j long, v double")


def dense_vectors(m, n, kind):
    used = np.flatnonzero(m.sum(axis=0) > 0)
    m = m[np.ix_(used, used)]
    m = {"correlation": correlation, "laplacian": normalized_laplacian, "map": lambda x: x}[kind](m)
    return used, eigenvectors(m, n, smallest=kind == "laplacian")


@pytest.mark.parametrize("kind", ["correlation", "laplacian"])
def test_vectors_equal_the_dense_ones(spark, kind):
    made = maps({"a": 64, "b": 9})
    found = {c: {} for c in made}
    for r in spectral.leading_vectors(cells_of(spark, made), 3, kind).collect():
        found[r.chrom][r.idx] = r.vectors
    for c, m in made.items():
        used, want = dense_vectors(m, 3, kind)
        assert sorted(found[c]) == used.tolist()
        got = np.array([found[c][i] for i in used.tolist()])
        assert np.abs(np.abs((got * want).sum(axis=0)) - 1).max() < 1e-6
        assert np.allclose(np.linalg.norm(got, axis=0), 1)


def test_a_basis_is_orthonormal_and_drops_what_it_holds():
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.random((20, 3)))[0]
    block = np.c_[basis[:, 0] * 5, rng.random(20)]
    q = spectral._orthonormal(block, basis)
    assert np.allclose(sorted(np.linalg.norm(q, axis=0)), [0, 1]) and np.allclose(basis.T @ q, 0)
    assert np.allclose(np.c_[basis, q] @ (np.c_[basis, q].T @ block), block)


def test_an_unknown_kind_and_an_empty_map(spark):
    with pytest.raises(ValueError):
        spectral.leading_vectors(cells_of(spark, maps({"a": 5})), 2, "other")
    assert spectral.leading_vectors(cells_of(spark, maps({"a": 5})).where("v < 0"), 2).count() == 0


def genome(spark, made):
    """Cells over all bins, and the bins."""
    starts, rows, bins = 0, [], []
    for c, m in made.items():
        bins += [(starts + k, c, k) for k in range(len(m))]
        rows += [(starts + int(i), starts + int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
        starts += len(m)
    return spark.createDataFrame(rows, "i long, j long, v double"), spark.createDataFrame(bins, "bin long, chrom string, idx long")


def test_compartments_and_tables_do_not_depend_on_the_way(spark):
    from contactloom.operators import compare, normalize, segment

    made = maps({"a": 50, "b": 30})
    cells, bins = genome(spark, made)
    decay = normalize.decay(cells, bins)
    rich = bins.select("chrom", "idx", (bins.idx % 7).cast("double").alias("value"))
    for track in (rich,):
        ways = [segment.compartments(cells, bins, decay, track, dense_limit=k).orderBy("chrom", "start").collect() for k in (40, 4_000)]
        assert [(r.chrom, r.start, r.end, r.type) for r in ways[0]] == [(r.chrom, r.start, r.end, r.type) for r in ways[1]] and len(ways[0]) > 4
        assert np.allclose([r.value for r in ways[0]], [r.value for r in ways[1]], atol=1e-6)
    other, _ = genome(spark, maps({"a": 50, "b": 30}, seed=8, empty=(7,)))
    tables = [compare.eigenvector_table(cells, other, bins, 2, True, k).orderBy("chrom", "x", "y").collect() for k in (40, 4_000)]
    assert [(r.chrom, r.x, r.y) for r in tables[0]] == [(r.chrom, r.x, r.y) for r in tables[1]] and len(tables[0]) == 8
    for column in ("corr", "distance", "ipr_a", "ipr_b"):
        assert np.allclose([r[column] for r in tables[0]], [r[column] for r in tables[1]], atol=1e-5)
