"""Direct tests of functions, sources and sinks that no registered query covers."""

import math
import random
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contactloom.functions import geometry, maths, text
from contactloom.operators import badbins, borders, compare, models3d, normalize, pairs, restraints, stats
from contactloom.plans import verbs
from contactloom.plans.jobs import Catalogue
from contactloom.functions import segmentation
from contactloom.sources import annotations, contact_bam, container_tables, reads, sinks


def contacts(spark, n=300, seed=4):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        c1, c2, p1 = rng.choice("ab"), rng.choice("ab"), rng.randrange(1, 900_000)
        p2 = rng.randrange(1, 900_000)
        rows.append((f"r{k}", c1, p1, rng.randrange(2), 50, p1 // 4096 * 4096 + 1, p1 // 4096 * 4096 + 4097, c2, p2, rng.randrange(2), 40, p2 // 4096 * 4096 + 1, p2 // 4096 * 4096 + 4097, k % 1024, 1 + k % 3))
    return spark.createDataFrame(rows, "read_id string, c1 string, p1 long, s1 int, l1 int, rs1 long, re1 long, c2 string, p2 long, s2 int, l2 int, rs2 long, re2 long, flag int, multi int")


def test_contacts_round_trip_through_bam(spark, monkeypatch, tmp_path):
    made = contacts(spark)
    files = contact_bam.encoded(made, [("a", 900_000), ("b", 900_000)]).collect()
    folder = tmp_path / "maps"
    folder.mkdir()
    for r in files:
        (folder / f"{r.part}.bam").write_bytes(r.content)
        assert r.content[:4] == b"\x1f\x8b\x08\x04" and r.content.endswith(contact_bam._EOF)
    back = contact_bam.read_contacts(spark, str(folder))
    assert back.columns == made.columns and sorted(back.collect()) == sorted(made.collect())
    both = contact_bam.read_contacts(spark, str(folder), both=True)
    assert both.count() == 2 * made.count() and both.where("read_id = 'r7'").select("c1", "p1").distinct().count() <= 2
    assert [tuple(r) for r in contact_bam.read_references(spark, str(folder)).collect()] == [("a", 900_000), ("b", 900_000)]
    short = contact_bam.decoded(contact_bam.encoded(made.drop("flag", "multi"), [("a", 900_000), ("b", 900_000)], long=False)).collect()
    assert {(r.flag, r.multi, r.rs1) for r in short} == {(0, 1, None)}
    assert contact_bam.encoded(made.limit(0), [("a", 9)]).count() == 0


def test_bam_blocks_follow_the_format():
    data = bytes(range(256)) * 1000
    out = contact_bam._compressed(data)
    at, seen = 0, 0
    while at < len(out):
        size = struct.unpack_from("<H", out, at + 16)[0] + 1
        seen += struct.unpack_from("<I", out, at + size - 4)[0]
        at += size
    assert at == len(out) and seen == len(data)
    assert contact_bam._bin(0, 1) == 4681 and contact_bam._bin(0, 1 << 29) == 0 and contact_bam._bin(16383, 16385) == 585


def test_depth_limits_on_a_plain_case():
    rng = np.random.default_rng(2)
    share = np.r_[rng.uniform(0, 1, 150), rng.normal(0.8, 0.02, 1500), rng.uniform(0, 1, 150)]
    left, right = maths.depth_limits(share, len(share))
    assert 100 < left < 250 and 1550 < right < 1800
    assert maths.depth_limits(share, len(share), min_perc=10, max_perc=90) == (180, 1620)
    with pytest.raises(ValueError):
        maths.depth_limits(np.tile([0.0, 1.0], 50), 100, sigma=0.01)


def test_low_root_finds_the_dip_between_two_modes(spark):
    rng = np.random.default_rng(1)
    totals = np.r_[rng.normal(100, 25, 60), rng.normal(1000, 120, 2500)]
    root = maths.low_root(totals)
    assert 150 < root < 720 and maths.low_root([]) == 0.0 and maths.low_root([5.0] * 20) == 0.0
    cells = spark.createDataFrame([(i, i, float(v)) for i, v in enumerate(totals)], "i long, j long, v double")
    found = badbins.by_mean(cells, spark.range(len(totals)).withColumnRenamed("id", "bin"))
    assert found.count() == (totals < root).sum() > 50


def test_additive_biases_follow_their_covariates(spark):
    rng = np.random.default_rng(3)
    n = 2000
    x = pd.DataFrame({"bin": np.arange(n), "map": rng.uniform(0, 1, n), "cg": rng.uniform(0.3, 0.6, n), "res": rng.integers(0, 12, n).astype(float)})
    mean = 200 * np.exp(1.5 * x["map"] - 20 * (x["cg"] - 0.45) ** 2 + 0.05 * x["res"])
    sums = spark.createDataFrame(pd.DataFrame({"bin": np.arange(n), "s": rng.poisson(mean).astype(float)}))
    bias = normalize.one_d(sums, spark.createDataFrame(x)).toPandas().sort_values("bin")["b"].to_numpy()
    assert bias.mean() == pytest.approx(1) and np.abs(bias / (mean / mean.mean()) - 1).max() < 0.1
    part = normalize.one_d(sums, spark.createDataFrame(x), p_fit=0.5).toPandas().sort_values("bin")["b"].to_numpy()
    assert np.corrcoef(part, mean)[0, 1] > 0.99
    assert normalize.one_d(sums.limit(0), spark.createDataFrame(x)).count() == 0


def test_ranks_and_correlations(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randrange(20)) if k % 11 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    found = {r.k: r.r for r in compare.with_rank(df, "v", "r").collect()} if True else {}
    known = sorted(v for _, v in rows if v is not None)
    for k, v in rows:
        want = None if v is None else (known.index(v) + 1 + len(known) - known[::-1].index(v)) / 2
        assert found[k] == want
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    assert flat.agg(compare.known_corr(F.col("a"), F.col("b")).alias("c")).first().c is None


def test_site_classes_of_single_pairs(spark):
    #            c1  p1  s1  rs1 re1  c2  p2  s2 rs2 re2
    cases = {
        18: ("a", 900, 1, 1, 1000, "a", 5900, 1, 5001, 6000),
        17: ("a", 900, 1, 1, 1000, "a", 5100, 0, 5001, 6000),
        16: ("a", 100, 0, 1, 1000, "a", 5900, 1, 5001, 6000),
        19: ("a", 100, 0, 1, 1000, "b", 5100, 0, 5001, 6000),
        14: ("a", 100, 0, 1, 1000, "a", 900, 1, 1, 1000),
        15: ("a", 300, 1, 1, 1000, "a", 600, 0, 1, 1000),
        13: ("a", 900, 1, 1, 1000, "a", 1100, 0, 1000, 2000),
        11: ("a", 2, 1, 1, 1000, "a", 400, 0, 1, 1000),
        12: ("a", 400, 1, 1, 1000, "a", 502, 0, 1, 500),
        20: ("a", 5000, 1, 1, 100_000, "b", 50, 1, 1, 100_000),
    }
    rows = [(str(k), c[0], c[1], c[2], 50, c[3], c[4], c[5], c[6], c[7], 50, c[8], c[9]) for k, c in cases.items()]
    df = spark.createDataFrame(rows, "read_id string, c1 string, p1 long, s1 int, l1 int, rs1 long, re1 long, c2 string, p2 long, s2 int, l2 int, rs2 long, re2 long")
    assert {int(r.read_id): r.category for r in pairs.site_classes(df, 500).collect()} == {k: k for k in cases}
    assert set(pairs.SITE_CLASSES) == set(cases)


def test_numbers():
    assert maths.log_or_half_minimum([100, 0, 10]) == pytest.approx([2, math.log10(5), 1])
    assert maths.mean_of_known([1, None, 3]) == 2 and maths.mean_of_known([None]) is None
    assert maths.mad([1, 2, 3, 4, 100]) == 1
    assert text.round_to(3.14159, 2) == 3.14 and text.repaired("MboI") == "GATC" and text.repaired("HindIII") == "AGCTT"
    points = [(s, maths.chain_square_distance(s, 7.0)) for s in (5, 20, 80)]
    assert maths.fit_persistence(points) == pytest.approx(7, rel=1e-3)


def test_geometry():
    sphere = geometry.sphere_points(200)
    assert np.allclose(np.linalg.norm(sphere, axis=1), 1) and np.abs(sphere.mean(axis=0)).max() < 0.02
    circle = geometry.circle_points([1, 2, 3], [0, 0, 2], 5, 12)
    assert np.allclose(np.linalg.norm(circle - [1, 2, 3], axis=1), 5) and np.allclose(circle[:, 2], 3)
    x = np.random.default_rng(1).normal(0, 1, (8, 3))
    assert np.allclose(geometry.centred(x).mean(axis=0), 0)
    turned = geometry.rotated_about_y(x, 0.7)
    assert np.allclose(turned[:, 1], x[:, 1]) and np.allclose(np.linalg.norm(turned, axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(geometry.superposed(turned + 4, x), x)
    assert geometry.angle([1, 0, 0], [0, 0, 0], [0, 2, 0]) == pytest.approx(math.pi / 2)
    assert abs(geometry.dihedral([1, 0, 0], [0, 0, 0], [0, 0, 1], [0, 1, 1])) == pytest.approx(math.pi / 2)
    assert geometry.volume(np.zeros((1, 3)), 10, 0.5) == pytest.approx(4 / 3 * math.pi * 1000, rel=0.02)


def particles(spark, n_models=5, n=12):
    rng = np.random.default_rng(6)
    base = rng.normal(0, 1, (n, 3)).cumsum(axis=0)
    rows = []
    for m in range(n_models):
        x = geometry.rotated_about_y(base + rng.normal(0, 0.05 * (m + 1), (n, 3)), m) + m
        rows += [(m, k, *map(float, x[k])) for k in range(n)]
    return spark.createDataFrame(rows, "model long, particle long, x double, y double, z double"), base


def test_models(spark):
    p, base = particles(spark)
    mean = models3d.average_model(p, 0).orderBy("particle").select("x", "y", "z").toPandas().to_numpy()
    gap = lambda a: np.linalg.norm(a[:, None] - a[None], axis=2)
    assert np.abs(gap(mean) - gap(base)).max() < 0.4
    assert models3d.persistence(p, 1.0) > 0
    lengths = models3d.persistence_lengths(p).collect()
    assert len(lengths) == 5 and all(r.persistence > 0 for r in lengths)
    volumes = {r.model: r.volume for r in models3d.volumes(p, 0.5, 0.1).collect()}
    assert len(volumes) == 5 and all(0.4 < v < 12 * 0.55 for v in volumes.values())
    lonely = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 0.01, 0.0, 0.0), (0, 2, 99.0, 0.0, 0.0)], "model long, particle long, x double, y double, z double")
    assert models3d.inaccessible(lonely, 1.0).count() == 0
    at = p.where("model = 0").orderBy("particle").select("x", "y", "z").toPandas().to_numpy()
    one = p.where("model = 0")
    assert models3d.angle_between(one, 1, 4, 7).first().angle == pytest.approx(math.degrees(geometry.angle(at[1], at[4], at[7])), abs=1e-6)
    assert models3d.median_distance(p, 2, 9).first().d > 0
    pairs_of = {(r.a, r.b) for r in models3d.model_scores(p, 1.0).collect()}
    assert pairs_of == {(a, b) for a in range(5) for b in range(a + 1, 5)}


def test_parameters_and_restraints(spark):
    grid = restraints.grid(spark, low=[0, 1], high=[2, 3]).withColumn("corr", F.col("low") - F.abs(F.col("high") - 3))
    assert grid.count() == 4 and tuple(restraints.best_parameters(grid).first()) == (3.0, 1.0, 1.0) or tuple(restraints.best_parameters(grid).first()) == (1.0, 3.0, 1.0)


def test_statistics_of_reads(spark):
    df = spark.createDataFrame([("ACGN", "IIII"), ("GATC", "!!II"), ("GGGG", "IIII")], "seq string, qual string")
    found = {r.pos: r for r in stats.read_quality(df).collect()}
    assert found[0].n == 3 and found[0].mean == pytest.approx((40 + 0 + 40) / 3) and found[3].unknown == 1
    assert tuple(stats.site_counts(df, {"GATC": "GATC", "GG": "GG"}).first()) == (3, 1, 1)
    genome = spark.createDataFrame([("a", "GGCCNNAT" * 3), ("b", "")], "chrom string, seq string")
    assert {(r.chrom, r.bin): r.gc for r in stats.base_content(genome, 8).collect()} == {("a", k): pytest.approx(4 / 6) for k in range(3)}


def test_alignments_and_synteny(spark, tmp_path):
    (tmp_path / "x.maf").write_text("##maf\n\na score=1\ns hs.chr1 10 20 + 100 ACGT\ns mm.chr5 5 20 - 200 ACGT\n\na\ns hs.chr2 1 9 + 50 A\ns mm.chr6 3 9 + 60 A\n\na\ns hs.chr3 1 9 + 50 A\n")
    found = annotations.read_alignments(spark, str(tmp_path / "x.maf"), "hs", "mm").orderBy("chrom").collect()
    assert [tuple(r) for r in found] == [("chr1", 10, 30, "chr5", 175, 195, -1), ("chr2", 1, 10, "chr6", 3, 12, 1)]
    (tmp_path / "syn").write_text("chr1 0 1000 chr5 0 9000 -\nchr2 0 5 chr6 0 5 1\n\n")
    blocks = annotations.read_synteny(spark, str(tmp_path / "syn")).collect()
    assert [(r.schrom, r.send, r.tchrom, r.tstrand) for r in blocks] == [("chr1", 1000, "chr5", -1), ("chr2", 5, "chr6", 1)]


def test_read_ends(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("# a\nr1\tc\t5\t1\t50\t1\t9\nr2\tc\t7\t0\t40\t1\t9|||r2\td\t8\t1\t30\t2\t10\n")
    found = reads.read_ends(spark, str(tmp_path / "e.tsv")).orderBy("name", "chrom").collect()
    assert [(r.name, r.chrom, r.pos, r.len) for r in found] == [("r1", "c", 5, 50), ("r2", "c", 7, 40), ("r2", "d", 8, 30)]


def test_sinks(spark, tmp_path):
    bins = spark.createDataFrame([(0, "a", 0, 0, 10), (1, "a", 1, 10, 20)], "bin long, chrom string, idx long, start long, end long")
    cells = spark.createDataFrame([(0, 1, 3.0), (1, 0, 3.0)], "i long, j long, v double")
    sinks.write_coordinates(cells, bins, str(tmp_path / "co"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "co")).collect()) == ["a:1-10\ta:11-20\t3.0", "a:11-20\ta:1-10\t3.0"]
    sinks.write_domains(spark.createDataFrame([("a", 0, 9)], "chrom string, start long, end long").coalesce(1), str(tmp_path / "do"))
    assert [r.value for r in spark.read.text(str(tmp_path / "do")).collect()] == ["chrom\tstart\tend", "a\t1\t10"]
    sinks.write_json(sinks.map_json(cells, name="x"), str(tmp_path / "js"))
    assert spark.read.text(str(tmp_path / "js")).count() == sinks.map_json(cells, name="x").count()
    sinks.write_tables(str(tmp_path / "ta"), bias=cells, settings=spark.createDataFrame([(5,)], "resolution int"))
    assert sinks.read_tables(spark, str(tmp_path / "ta"), "bias", resolution=5)["bias"].count() == 2
    with pytest.raises(ValueError):
        sinks.read_tables(spark, str(tmp_path / "ta"), "bias", resolution=6)


def test_catalogue_deletes_by_hiding(spark, tmp_path):
    jobs = Catalogue(spark, str(tmp_path / "jobs"))
    a = jobs.add_job({"x": 1}, "map", 0.0, {"one": "map"})
    jobs.delete("jobs", "id", a)
    assert not jobs.already_run({"x": 1}, "map") and jobs.next_id() == a + 1
    b = jobs.add_job({"x": 1}, "map", 0.0)
    assert b == a + 1 and jobs.already_run({"x": 1}, "map")
    jobs.delete("jobs", "type", "map")
    assert jobs.table("jobs").count() == 0
    jobs.add_job({"x": 2}, "map", 0.0)
    assert jobs.table("jobs").count() == 1


def test_alignment_columns(spark):
    rows = [("e1", "a", 100.0), ("e1", "a", 900.0), ("e2", "a", 120.0), ("e2", "a", 905.0), ("e3", "a", 880.0)]
    found = borders.align(spark.createDataFrame(rows, "experiment string, chrom string, pos double"), max_dist=50.0)
    assert borders.columns_where(found, F.col("pos").isNotNull(), 3).count() == 1
    assert borders.columns_where(found, F.col("pos").isNotNull(), 2).count() == 2


def test_merge_verb(spark):
    bins = spark.createDataFrame([(k, "a", k) for k in range(8)], "bin long, chrom string, idx long")
    rng = random.Random(1)
    a = spark.createDataFrame([(i, j, rng.randrange(1, 9)) for i in range(8) for j in range(i, 8)], "i long, j long, v long")
    total, corr = verbs.merge(a, a, bins, 3)
    assert total.agg(F.sum("v")).first()[0] == 2 * a.agg(F.sum("v")).first()[0]
    assert {round(r.spearman, 9) for r in corr.collect()} == {1.0}


def test_container_tables(spark, tmp_path):
    bins = spark.createDataFrame([(k, "ab"[k // 2], k % 2 * 10, k % 2 * 10 + 10) for k in range(4)], "bin long, chrom string, start long, end long")
    chroms = spark.createDataFrame([("a", 20), ("b", 20)], "name string, length long")
    half = spark.createDataFrame([(0, 1, 4), (3, 2, 6), (1, 1, 2), (0, 3, 9)], "i long, j long, v long")
    bias = spark.createDataFrame([(0, 2.0), (1, 4.0), (2, 0.5)], "bin long, b double")
    path = str(tmp_path / "map")
    assert not container_tables.is_container(spark, path)
    container_tables.write_container(path, 10, half, bins, chroms, bias)
    assert container_tables.is_container(spark, path) and container_tables.is_container(spark, path, 10) and not container_tables.is_container(spark, path, 20)
    assert [tuple(r) for r in container_tables.read_chroms(spark, path, 10).orderBy("name").collect()] == [("a", 20), ("b", 20)]
    raw, back = container_tables.read_container(spark, path, 10)
    assert sorted(map(tuple, raw.collect())) == [(0, 1, 4), (0, 3, 9), (1, 1, 2), (2, 3, 6)]
    assert {r.bin: r.weight for r in back.collect()} == {0: 0.5, 1: 0.25, 2: 2.0, 3: None}
    norm, _ = container_tables.read_container(spark, path, 10, normalized=True)
    assert {(r.i, r.j): r.v for r in norm.collect()} == {(0, 1): 0.5, (1, 1): 0.125}
    assert container_tables.read_container(spark, path, 10, raw=False)[0].count() == 2


def test_results_of_a_grid_are_read_again(spark, tmp_path):
    grid = spark.createDataFrame([(1.0, 2.0, 0.5), (3.0, 4.0, 0.9)], "low double, high double, corr double")
    restraints.write_results(grid, str(tmp_path / "g"))
    assert [tuple(r) for r in restraints.read_results(spark, str(tmp_path / "g")).collect()] == [(3.0, 4.0, 0.9), (1.0, 2.0, 0.5)]


def test_merged_overlap_and_small_numbers():
    a, b = np.arange(9.0).reshape(3, 3), np.arange(4.0).reshape(2, 2)
    first, second, both = segmentation.merged_overlap(a, b, [(0, None), (1, 0), (None, 1), (2, None)])
    assert first[0, 1] == 1 and np.isnan(first[2]).all() and second[1, 2] == 1 and both[1, 1] == (4 + 0) / 2 and np.isnan(both[0]).all()
    assert maths.log10_or_infinity([100, 0]).tolist() == [2.0, -math.inf]
    assert maths.explained(lambda x: 2 * x, [1, 2, 3], [2, 4, 6]) == 1.0 and maths.explained(lambda x: 4, [1, 2, 3], [2, 4, 6]) == 0.0


def test_pieces_of_split_reads_become_all_pairs(spark, tmp_path):
    line = lambda name, flag, pos, mapq, cigar: f"{name}\t{flag}\tc\t{pos}\t{mapq}\t{cigar}\t*\t0\t0\tACGT\tIIII\n"
    text = "@HD\tx\n" + line("a", 65, 100, 60, "10S20M") + line("a", 2065, 500, 60, "5M2D5M3I") + line("a", 129, 900, 4, "30M") + line("b", 65, 1, 3, "4M") + line("b", 129, 5, 60, "4M") + line("d", 0, 7, 60, "4M")
    (tmp_path / "r.sam").write_text(text)
    ends = reads.read_split_sam(spark, str(tmp_path / "r.sam"))
    assert sorted((r.name, r.pos, r.strand, r.len) for r in ends.collect()) == [("a", 100, 1, 20), ("a", 511, 0, 12), ("a", 900, 1, 30), ("b", 5, 1, 4)]
    frags = spark.createDataFrame([("c", 1, 400), ("c", 400, 800), ("c", 800, 2000)], "chrom string, start long, end long")
    found = reads.all_contacts(reads.with_fragment(ends, frags)).collect()
    assert {(r.read_id, r.p1, r.p2) for r in found} == {("a#1/3", 100, 511), ("a#2/3", 100, 900), ("a#3/3", 511, 900)}
