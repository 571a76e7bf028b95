"""Interval, domain, model and synteny files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, value) of BED3, BED4, BED6, bedGraph or two-column lines; value 1 where there is no score."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(?:#|track|browser)") & (F.trim("value") != ""))
    part = F.split(F.trim("value"), r"\s+")
    n = F.size(part)
    score = F.when(n >= 6, F.expr("try_cast(split(trim(value), '\\\\s+')[4] AS double)")).when(n == 4, F.expr("try_cast(split(trim(value), '\\\\s+')[3] AS double)"))
    start = part[1].cast("long")
    return lines.select(part[0].alias("chrom"), start.alias("start"), F.when(n >= 3, F.try_element_at(part, F.lit(3)).cast("long")).otherwise(start).alias("end"), F.coalesce(score, F.lit(1.0)).alias("value"))


def binned(intervals: DataFrame, resolution: int) -> DataFrame:
    """(chrom, bin, value): scores summed at the bin of each interval's end."""
    return intervals.groupBy("chrom", F.floor(F.col("end") / resolution).cast("long").alias("bin")).agg(F.sum("value").alias("value"))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain, start, end, score, height): 1-based files to 0-based rows, a missing score is 10."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(part.alias("p"))
    number = lambda k: F.try_element_at("p", F.lit(k)).try_cast("double")
    return lines.select(
        number(1).cast("int").alias("domain"), (number(2) - 1).cast("long").alias("start"), (number(3) - 1).cast("long").alias("end"),
        F.coalesce(number(4), F.lit(10.0)).alias("score"), number(5).alias("height"),
    )


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(model, particle, x, y, z) of XYZ files; the model is the file's number in name order.  Comment lines are skipped."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    found = F.regexp_extract_all("value", F.lit(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0))
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select("file", F.split(F.trim("value"), r"\s+").alias("p"), found.alias("f")).where(F.size("p") >= 4)
    from pyspark.sql import Window

    last = lambda k: F.element_at("p", -k).cast("double")
    files = rows.select("file").distinct().withColumn("model", F.row_number().over(Window.orderBy("file")) - 1)
    rows = rows.join(F.broadcast(files), "file")
    return rows.select(F.col("model").cast("long").alias("model"), F.try_element_at("p", F.lit(2)).try_cast("long").alias("particle"), last(3).alias("x"), last(2).alias("y"), last(1).alias("z"))


def read_cmm(spark: SparkSession, path: str) -> DataFrame:
    """(particle, x, y, z, radius) of marker files."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"<marker\s[^>]*>"), F.lit(0))).alias("m"))
    attr = lambda name: F.regexp_extract("m", rf'\b{name}="([^"]*)"', 1)
    return text.select((attr("id").cast("long") - 1).alias("particle"), *[attr(k).cast("double").alias(k) for k in "xyz"], attr("radius").cast("double").alias("radius"))


def read_synteny(spark: SparkSession, path: str) -> DataFrame:
    """(schrom, sstart, send, tchrom, tstart, tend, tstrand) of seven-column files."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    long = lambda k: part[k].cast("long")
    return rows.select(part[0].alias("schrom"), long(1).alias("sstart"), long(2).alias("send"), part[3].alias("tchrom"), long(4).alias("tstart"), long(5).alias("tend"), F.when(part[6].isin("-", "-1"), -1).otherwise(1).alias("tstrand"))


def read_alignments(spark: SparkSession, path: str, seed: str, target: str) -> DataFrame:
    """Blocks (chrom, bstart, bend, tchrom, tstart, tend, tstrand) of two species in MAF text, a paragraph a block."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").contains("\ns "))
    line = lambda species: F.split(F.regexp_extract("value", rf"\ns\s+({species}\.[^\n]*)", 1), r"\s+")
    rows = blocks.select(line(seed).alias("a"), line(target).alias("b")).where("size(a) > 4 AND size(b) > 4")
    long = lambda c, k: F.col(c)[k].cast("long")
    forward = F.col("b")[3] == "+"
    start = F.when(forward, long("b", 1)).otherwise(long("b", 4) - long("b", 1) - long("b", 2))
    chrom = lambda c: F.regexp_replace(F.col(c)[0], r"^[^.]*\.", "")
    return rows.select(chrom("a").alias("chrom"), long("a", 1).alias("bstart"), (long("a", 1) + long("a", 2)).alias("bend"), chrom("b").alias("tchrom"), start.alias("tstart"), (start + long("b", 2)).alias("tend"), F.when(forward, 1).otherwise(-1).alias("tstrand"))
