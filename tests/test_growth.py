"""Work of single steps as their input grows."""

import glob

from pyspark.sql import functions as F

from contactloom.operators import pixels
from contactloom.plans import inputs as I
from contactloom.sources import bam_blocks, contact_bam
from test_bam_blocks import CHROMS, SCHEMA, pairs


def test_filters_on_bins_do_not_repeat_their_expressions(spark):
    """Filters that joins add on i and j stay above the bins: below, a method too long for the compiler ran interpreted."""
    lines = spark.createDataFrame([(1, 2, 3, 1, 5.0), (2, 7, 3, 2, 9.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double")
    rows = spark.sql(I._END.format(d="div").replace("from lineitem)", "from {lines})"), lines=lines)
    half = pixels.half_pixels(rows, I.bin_of(1), I.bin_of(2)).join(I.bins(spark).select(F.col("bin").alias("i")), "i")
    plan = half._jdf.queryExecution().optimizedPlan().toString()
    assert max(len(line) for line in plan.splitlines() if "Filter" in line) < 400
    assert sorted(map(tuple, pixels.half_pixels(rows, I.bin_of(1), I.bin_of(2)).collect())) == sorted(
        (*sorted((r.c1 * 32 + r.p1 // 100_000, r.c2 * 32 + r.p2 // 100_000)), 1) for r in rows.collect()
    )


def test_number_of_files_follows_the_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bam_blocks, "RECORDS", 500)
    rows = pairs(3000)
    contact_bam.write_contacts(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "map"), CHROMS)
    assert 10 <= len(glob.glob(f"{tmp_path}/map/*.bam")) <= 12
    assert contact_bam.read_contacts(spark, str(tmp_path / "map")).count() == 3000
