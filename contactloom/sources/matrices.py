"""Text matrices to pixels (i, j, v)."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.sources.lines import numbered


def header(spark: SparkSession, path: str) -> dict:
    """Chromosomes, masked bins, resolution and region from ``#`` lines: a small driver-side read."""
    found: dict = {"chromosomes": {}, "masked": [], "resolution": None, "region": None}
    for (text,) in spark.read.text(path).where(F.col("value").startswith("#")).collect():
        if m := re.match(r"#\s*CRM\s+(\S+)\s+(\d+)", text):
            found["chromosomes"][m[1]] = int(m[2])
        elif m := re.match(r"#\s*MASKED\s*(.*)", text):
            found["masked"] += [int(x) for x in re.findall(r"\d+", m[1])]
        if m := re.search(r"resolution:?\s*(\d+)", text, re.IGNORECASE):
            found["resolution"] = int(m[1])
        if m := re.search(r"(\S+):(\d+)-(\d+)", text):
            found["region"] = (m[1], int(m[2]), int(m[3]))
    return found


def is_sparse(spark: SparkSession, path: str) -> bool:
    """Whether the first lines are ``bin1 bin2 value``."""
    first = [r[0].split() for r in spark.read.text(path).where(~F.col("value").startswith("#")).limit(5).collect()]
    return bool(first) and all(len(x) == 3 for x in first) and len(first) > 3 or bool(first) and all(len(x) == 3 and x[0].isdigit() and x[1].isdigit() for x in first) and len(first) < 3


def read_sparse(spark: SparkSession, path: str, offset: int = 0) -> DataFrame:
    """``bin1 bin2 value`` text."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select((part[0].cast("long") - offset).alias("i"), (part[1].cast("long") - offset).alias("j"), part[2].cast("double").alias("v"))


def row_names(names: list[str]) -> tuple[list[tuple[str, int, int]], int | None]:
    """(chromosome, start, end) of row names ``chrom|start-end`` and the resolution; differing widths raise."""
    found, widths = [], set()
    for name in names:
        m = re.match(r"^(.+?)[|:\s](\d+)-(\d+)$", name)
        if m is None:
            return [], None
        found.append((m[1], int(m[2]), int(m[3])))
        widths.add(abs(int(m[3]) - int(m[2])) + 1 if int(m[2]) % 10 == 1 else abs(int(m[3]) - int(m[2])))
    if len(widths) > 1 and len({w for w in widths}) > 2:
        raise ValueError("rows have different resolutions")
    return found, max(widths) if widths else None


def read_dense(spark: SparkSession, path: str, symmetrize: bool = True) -> DataFrame:
    """Square tab-separated matrix, with or without a header row and row-name columns.

    Values are rounded half up; missing ones are 0.  An asymmetric matrix is summed
    with its transpose.  Two lines are read on the driver to tell names from values.
    """
    lines = spark.read.text(path).select(F.col("value").alias("text")).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    body = numbered(lines, "i")
    head = [r["text"].split("\t") for r in body.orderBy("i").limit(2).collect()]
    number = re.compile(r"^(?:[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|nan|NaN|NA|NAN)$")
    has_header = bool(head) and not all(number.match(x.strip()) for x in head[0][1:] or head[0])
    sample = head[1] if has_header and len(head) > 1 else head[0]
    names = next((k for k, x in enumerate(sample) if number.match(x.strip())), len(sample))
    if has_header and names == 0 and len(head[0]) + 1 == len(sample):
        names = 1
    rows = body.where("i > 0").withColumn("i", F.col("i") - 1) if has_header else body
    cells = rows.select("i", F.posexplode(F.slice(F.split("text", "\t"), names + 1, 2**31 - 1)).alias("j", "x"))
    value = F.floor(F.expr("try_cast(trim(x) AS double)") + 0.5)
    cells = cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.when(F.isnan(value), None).otherwise(value).alias("v")).where("v <> 0")
    if not symmetrize:
        return cells
    mirror = cells.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    both = cells.join(mirror, ["i", "j"], "full").fillna(0.0, ["v", "w"])
    odd = both.agg(F.count_if(F.col("v") != F.col("w")).alias("odd"))
    value = F.when((F.col("odd") > 0) & (F.col("i") != F.col("j")), F.col("v") + F.col("w")).otherwise(F.col("v"))
    return both.crossJoin(F.broadcast(odd)).select("i", "j", value.alias("v")).where("v <> 0")


def from_memory(spark: SparkSession, values) -> DataFrame:
    """Pixels of a list of lists, a flat square sequence, or an array."""
    m = np.asarray(values, dtype=float)
    if m.ndim == 1:
        n = int(round(len(m) ** 0.5))
        if n * n != len(m):
            raise ValueError("the values do not make a square")
        m = m.reshape(n, n)
    i, j = np.nonzero(np.nan_to_num(m))
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], "i long, j long, v double")


def read_matrix(spark: SparkSession, thing, parser=None) -> DataFrame:
    """Pixels from a table, a path (dense, sparse, or Parquet), text, nested lists or an array; ``parser(spark, thing)`` overrides."""
    if parser is not None:
        return parser(spark, thing)
    if isinstance(thing, DataFrame):
        return thing.select("i", "j", "v")
    if isinstance(thing, str) and "\n" not in thing:
        if thing.rstrip("/").endswith(".parquet"):
            return spark.read.parquet(thing).select("i", "j", "v")
        return read_sparse(spark, thing) if is_sparse(spark, thing) else read_dense(spark, thing)
    if isinstance(thing, str):
        rows = [x.split() for x in thing.splitlines() if x.strip() and not x.startswith("#")]
        return from_memory(spark, [[float(v) for v in r] for r in rows])
    if isinstance(thing, (list, tuple, np.ndarray)):
        return from_memory(spark, thing)
    raise TypeError(f"cannot read a matrix from {type(thing).__name__}")
