"""Line numbers of text files without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ROW_BITS = 33


def numbered(lines: DataFrame, name: str = "n") -> DataFrame:
    """``lines`` with their number from 0, in file order.

    A row's id holds its partition and its place there; the partitions' row counts,
    one row each, are prefix-summed and joined back.
    """
    rows = lines.withColumn("__id", F.monotonically_increasing_id())
    rows = rows.withColumns({"__part": F.shiftright("__id", _ROW_BITS), "__row": F.col("__id").bitwiseAND((1 << _ROW_BITS) - 1)})
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__part").agg(F.count("*").alias("k"))
    offsets = counts.select("__part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("__offset"))
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.col("__row")).drop("__id", "__part", "__row", "__offset")
