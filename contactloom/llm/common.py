"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space and word classes of all contracts (ASCII white space only).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    A local session without one (tests) gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="ckpt")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def without(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """The columns of ``df`` except those that an output column replaces."""
    gone = {n.lower() for n in names}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in gone]


def words(text: Column) -> Column:
    """Array of words; empty for null and for blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


#: Partitions of a bounded sample: its statistics are gathered per task, so few tasks keep them small.
SAMPLE_PARTITIONS = 16


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, max_chars: int) -> DataFrame:
    """At most ``limit`` labelled rows (doc_id, label, text) with at most ``max_chars`` characters in all, chosen by a hash of the id.

    Both bounds hold whatever the size of the tables: at most ``limit`` ids are
    broadcast, rows of repeated ids count one by one, and rows are taken in the order of
    the hash until their texts fill ``max_chars``.  Labels of an id that contradict each
    other count as 1.
    """
    chosen = (
        labels.where(keep & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .withColumns({"h": F.xxhash64("doc_id"), "g": F.xxhash64("text"), "size": F.coalesce(F.length("text"), F.lit(0))})
        .orderBy("h", "doc_id", "g")
        .limit(limit)
    )
    before = Window.orderBy("h", "doc_id", "g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("total", F.sum("size").over(before)).where(F.col("total") <= max_chars).select("doc_id", "label", "text")
