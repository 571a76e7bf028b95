"""The tables of the usual multi-resolution contact container, as Parquet below ``<path>/resolutions/<resolution>``.

``chroms`` (name, length), ``bins`` (bin, chrom, start, end, weight), ``pixels`` (bin1_id,
bin2_id, count) of the upper triangle, sorted by bin inside a file so that regions prune
row groups.  Weights are the reciprocals of the biases; bins without a bias have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("chroms", "bins", "pixels")


def _folder(path: str, resolution: int) -> str:
    return f"{path.rstrip('/')}/resolutions/{resolution}"


def write_container(path: str, resolution: int, half: DataFrame, bins: DataFrame, chroms: DataFrame, bias: DataFrame | None = None) -> None:
    """Write a half map (i, j, v), bins (bin, chrom, start, end) and chroms (name, length)."""
    folder = _folder(path, resolution)
    weights = bins.select("bin", "chrom", "start", "end")
    if bias is None:
        weights = weights.withColumn("weight", F.lit(None).cast("double"))
    else:
        weights = weights.join(bias.select("bin", F.try_divide(F.lit(1.0), F.col("b")).alias("weight")), "bin", "left")
    chroms.select("name", "length").coalesce(1).write.mode("overwrite").parquet(f"{folder}/chroms")
    weights.repartitionByRange("bin").sortWithinPartitions("bin").write.mode("overwrite").parquet(f"{folder}/bins")
    pixels = half.select(F.least("i", "j").alias("bin1_id"), F.greatest("i", "j").alias("bin2_id"), F.col("v").alias("count"))
    pixels.repartitionByRange("bin1_id", "bin2_id").sortWithinPartitions("bin1_id", "bin2_id").write.mode("overwrite").parquet(f"{folder}/pixels")


def is_container(spark: SparkSession, path: str, resolution: int | None = None) -> bool:
    """Whether the path holds the three tables, at the given resolution or at any."""
    try:
        for t in TABLES:
            spark.read.parquet(f"{path.rstrip('/')}/resolutions/{resolution if resolution is not None else '*'}/{t}").schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    return True


def read_chroms(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    """(name, length) of the chromosomes."""
    return spark.read.parquet(f"{_folder(path, resolution)}/chroms")


def read_container(spark: SparkSession, path: str, resolution: int, normalized: bool = False, raw: bool = True) -> tuple[DataFrame, DataFrame]:
    """(half map, bins); with ``normalized`` counts times both weights, with ``raw`` false only cells whose bins both have one."""
    bins = spark.read.parquet(f"{_folder(path, resolution)}/bins")
    half = spark.read.parquet(f"{_folder(path, resolution)}/pixels").toDF("i", "j", "v")
    if normalized or not raw:
        weight = lambda s: bins.where("weight IS NOT NULL").select(F.col("bin").alias(s), F.col("weight").alias(f"w{s}"))
        half = half.join(weight("i"), "i").join(weight("j"), "j")
        half = half.select("i", "j", (F.col("v") * F.col("wi") * F.col("wj") if normalized else F.col("v")).alias("v"))
    return half, bins
