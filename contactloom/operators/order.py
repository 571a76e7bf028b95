"""Row numbers and moving windows over a whole table, dealt over tasks by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.operators.normalize import checkpointed


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place 0, 1, ... in the given order.

    Rows are dealt by ranges of the order; a place is the place inside the range plus the rows of the ranges
    before, of which there are as many as tasks.  The order should have no ties; tied rows get their places in any order.
    """
    ranged = checkpointed(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    placed = ranged.withColumn("__inside", inside).join(F.broadcast(offsets), "__range")
    return placed.withColumn(name, F.col("__offset") + F.col("__inside") - 1).drop("__range", "__inside", "__offset")


def over_neighbours(rows: DataFrame, order: list[str], before: int, after: int, chunk: int = 10_000, **values: Column) -> DataFrame:
    """``rows`` with aggregates ``values`` over each row's neighbours, from ``before`` rows before it to ``after`` behind it.

    Chunks of rows are dealt over tasks, each with the neighbours that its outer rows need.
    """
    placed = numbered(rows, order, "__place")
    home = F.expr(f"__place div {chunk}")
    least = F.greatest(F.col("__place") - after, F.lit(0))
    reach = F.sequence(F.floor(least / chunk), F.floor((F.col("__place") + before) / chunk))
    w = Window.partitionBy("__chunk").orderBy("__place").rowsBetween(-before, after)
    wide = placed.withColumn("__chunk", F.explode(reach)).select("*", *[v.over(w).alias(k) for k, v in values.items()])
    return wide.where(F.col("__chunk") == home).drop("__chunk", "__place")
