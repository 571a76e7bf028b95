import math

import numpy as np
import pytest

from contactloom.functions import hmm, maths, text
from contactloom.functions.segmentation import (
    global_alignment,
    likelihood_domains,
    overlap_alignment,
    progressive,
    rank_sum_less,
    reciprocal_matches,
    turning_points,
    window_domains,
)
from contactloom.operators import borders, segment


def blocks(sizes, inside=40.0, outside=2.0, seed=0):
    rng = np.random.default_rng(seed)
    n = sum(sizes)
    label = np.repeat(np.arange(len(sizes)), sizes)
    d = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    m = rng.poisson(np.where(label[:, None] == label[None, :], inside, outside) / np.sqrt(d + 1))
    return np.triu(m) + np.triu(m, 1).T


def test_likelihood_finds_planted_domains():
    found = likelihood_domains([blocks([8, 10, 7, 9])])
    assert [(a, b) for a, b, _ in found] == [(0, 7), (8, 17), (18, 24), (25, 33)]
    assert found[-1][2] is None and all(s > 5 for _, _, s in found[:-1])


def test_window_finds_planted_domains():
    found = window_domains(blocks([12, 14, 12]).astype(float), 4)
    ends = {b for _, b, _, _ in found}
    assert {11, 25} <= ends


def test_segments_per_chromosome(spark):
    from contactloom.operators import pixels

    m = blocks([8, 8])
    cells = spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")
    bins = pixels.bins_of(spark.createDataFrame([("x", 0, 1599)], "chrom string, ord int, length long"), 100)
    rows = segment.domains_by_likelihood(cells, bins).orderBy("start").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 7), (8, 15)]
    domains = spark.createDataFrame([("x", 0, 7), ("x", 8, 15)], "chrom string, start long, end long")
    for r in segment.domain_density(domains, cells, bins).collect():
        assert r.observed == np.triu(m[r.start : r.end + 1, r.start : r.end + 1]).sum() and r.height > 1


def test_compartments_follow_a_checkerboard(spark):
    from contactloom.operators import normalize, pixels

    label = np.array([0] * 6 + [1] * 6 + [0] * 6 + [1] * 6)
    m = np.where(label[:, None] == label[None, :], 60.0, 20.0)
    cells = spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m)], "i long, j long, v double")
    bins = pixels.bins_of(spark.createDataFrame([("x", 0, 2399)], "chrom string, ord int, length long"), 100)
    rich = spark.createDataFrame([("x", int(k), float(v)) for k, v in enumerate(label)], "chrom string, idx long, value double")
    rows = segment.compartments(cells, bins, normalize.decay(cells, bins), rich).orderBy("start").collect()
    assert [(r.start, r.end, r.type) for r in rows] == [(0, 5, "B"), (6, 11, "A"), (12, 17, "B"), (18, 23, "A")]


def test_hidden_states_of_two_levels():
    rng = np.random.default_rng(2)
    truth = np.repeat([0, 1, 0, 1], 30)
    assert (hmm.segment(truth * 4 + rng.normal(0, 0.5, 120), 2) == truth).mean() > 0.97


def test_rank_sum_and_turning_points():
    assert rank_sum_less(np.arange(10.0), np.arange(20.0, 40.0)) < 1e-4 < 0.5 < rank_sum_less(np.arange(20.0, 40.0), np.arange(10.0))
    low, _ = turning_points(np.array([5, 4, 3, 2, 1, 2, 3, 4, 5], dtype=float))
    assert low == [4]


def test_alignments():
    pairs, score = reciprocal_matches([10.0, 50.0, 90.0], [12.0, 88.0], 20)
    assert pairs == [(10.0, 12.0), (50.0, None), (90.0, 88.0)] and 0 < score < 1
    assert reciprocal_matches([1.0, 2.0], [1.0, 2.0], 20)[1] == 1
    pairs, _ = global_alignment([100_000.0, 500_000.0], [100_000.0, 300_000.0, 500_000.0])
    assert (100_000.0, 100_000.0) in pairs and (None, 300_000.0) in pairs and (500_000.0, 500_000.0) in pairs
    rows, score = progressive([[1.0, 5.0], [1.0, 5.0, 9.0], [5.0]], max_dist=1.0)
    assert len({len(r) for r in rows}) == 1 and rows[2].count(None) == 2
    m = blocks([6, 6]).astype(float)
    pairs, score = overlap_alignment(m, m)
    assert score == pytest.approx(1) and all(a == b for a, b in pairs)


def test_border_tables(spark):
    a = spark.createDataFrame([("x", 10), ("x", 200)], "chrom string, pos long")
    b = spark.createDataFrame([("x", 14), ("x", 6), ("x", 500)], "chrom string, pos long")
    assert [tuple(r) for r in borders.nearest(a, b, 50).collect()] == [("x", 10, 6, 4)]
    rows = spark.createDataFrame([(e, "x", float(p)) for e in "ab" for p in (1e6, 1.3e6, 3e6, 3.2e6, 5e6)], "experiment string, chrom string, pos double")
    found = borders.randomization_test(rows, 20).first()
    assert found.score == 1 and found.p < 0.5


def test_lift_and_blocks(spark):
    blocks_ = spark.createDataFrame([("x", 0, 1000, "y", 5000, 6000, 1), ("z", 0, 1000, "y", 0, 1000, -1)], "chrom string, bstart long, bend long, tchrom string, tstart long, tend long, tstrand int")
    parts = spark.createDataFrame([(1, "x", 100, 300), (2, "z", 100, 300), (3, "q", 1, 50)], "id long, chrom string, start long, end long")
    assert sorted(map(tuple, borders.lift(parts, blocks_).collect())) == [(1, "y", 5100, 5300), (2, "y", 700, 900)]
    two = spark.createDataFrame([("x", 0, 10, "y", 0, 10, 1), ("x", 10, 20, "y", 10, 20, 1), ("x", 50, 60, "y", 70, 80, 1)], blocks_.schema)
    assert borders.merged_blocks(two).count() == 2


def test_text_and_maths():
    assert text.resolution("100Kb") == 100_000 and text.resolution("1 Mb") == 1_000_000
    assert text.nicer(1_000_000) == "1 Mb" and text.nicer(1_500) == "1500 bp"
    assert text.complementary("GATTC") == "GAATC"
    assert text.religated(["HindIII"])[("HindIII", "HindIII")] == "AAGCTAGCTT"
    assert text.religated(["DpnII"])[("DpnII", "DpnII")] == "GATCGATC"
    assert text.enzyme("hindiii") == ("A", "AGCTT")
    z = maths.zscore([1.0, 10.0, 100.0])
    assert sum(z) == pytest.approx(0) and z[2] == pytest.approx(math.sqrt(1.5))
    p = maths.persistence_length(100.0, maths.chain_square_distance(100.0, 7.0))
    assert p == pytest.approx(7.0)
    assert maths.fit_persistence([(x, maths.chain_square_distance(x, 3.0)) for x in (1.0, 5.0, 20.0)]) == pytest.approx(3.0, rel=1e-3)
    assert maths.Interpolation([0.0, 1.0, 3.0], [0.0, 2.0, 0.0])(2.0) == 1.0
    assert maths.binomial_tail(1, 2, 0.5) == pytest.approx(0.75)


def test_remapping_in_two_steps_with_a_trace(spark):
    schema = "chrom string, bstart long, bend long, tchrom string, tstart long, tend long, tstrand int"
    # Bins of 100: the new assembly has a hole at 500 to 620, and a second block of "x" from 900 on.
    new = spark.createDataFrame([("x", 0, 500, "x", 1000, 1500, 1), ("x", 620, 940, "x", 1620, 1940, 1), ("x", 940, 2000, "x", 3000, 4060, 1), ("s", 0, 900, "scaffold", 0, 900, 1)], schema)
    # The other species: half as long and reversed, and nothing for 3500 onwards.
    other = spark.createDataFrame([("x", 1000, 2000, "7", 0, 500, -1), ("x", 3000, 3500, "9", 0, 500, 1), ("scaffold", 0, 900, "un_1", 0, 900, 1)], schema)
    marks = spark.createDataFrame([("x", e) for e in (0, 1, 2, 2, 5, 9, 11, 16)] + [("s", 3), ("q", 1), (None, 4), ("x", None)], "chrom string, end long")
    trace = {(r.chrom, r.end): r for r in borders.remapped(marks, 100, new, other, names="^[0-9]+$").collect()}
    assert len(trace) == 9
    status = {k: r.status for k, r in trace.items()}
    assert status[("x", 5)] == status[("q", 1)] == "lost in assembly" and status[("x", 16)] == "lost in synteny" and status[("s", 3)] == "off names"
    r = trace[("x", 0)]  # 0-100, 1000-1100, then the last 50 of 500; the next border ends at 450, so both come to bin 5
    assert (r.mid_chrom, r.mid_start, r.mid_end, r.to_chrom, r.to_start, r.to_end, r.to_bin, r.status) == ("x", 1000, 1100, "7", 450, 500, 5, "merged")
    assert [(trace[("x", e)].to_bin, trace[("x", e)].status) for e in (1, 2)] == [(5, "merged"), (4, "moved")]
    assert trace[("x", 9)].status == "split" and trace[("x", 9)].mid_start == 3000 and trace[("x", 11)].status == "moved"
    lost = trace[("x", 16)]
    assert (lost.mid_start, lost.to_chrom, lost.to_bin) == (3660, None, None)
    domains = spark.createDataFrame([("x", 0, 0.2), ("x", 1, 0.9), ("x", 2, 0.5), ("x", 5, 1.0), ("x", 9, 0.1)], "chrom string, end long, score double")
    found = borders.remapped_domains(domains, borders.remapped(marks, 100, new, other))
    assert sorted(map(tuple, found.collect())) == [("7", 0, 4, 0.5), ("7", 5, 5, 0.9), ("9", 0, 1, 0.1)]
    # Without maps borders keep their span, and its end rounds to the bin after.
    assert {(r.end, r.to_bin, r.status) for r in borders.remapped(marks.where("chrom = 'q'"), 100).collect()} == {(1, 2, "moved")}
    assert borders.remapped(marks.where("false"), 100, new, other).count() == 0
