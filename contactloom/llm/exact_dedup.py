"""Exact deduplication by skew-safe combining (DataFrame functions only).

Texts are equal when identical after replacing every run of ASCII white space by
one space; a null text equals an empty one.  Of equal texts the row with the
smallest ``doc_id`` stays.

Stage 1 groups by (digest, salt, whole text).  Its map-side aggregate leaves one
row per task, salt and text: the local deduplication.  Its reduce side merges the
salted digest groups.  Stage 2 combines the at most ``SALTS`` salt winners of every
text, again by the whole text.  It sees all texts of a digest side by side and so
proves whether the digest stands for one text.

Winners go back to the documents by (digest, salt), so a text that fills a third of
the table is dealt over ``SALTS`` tasks at every step.  Where a digest stands for
one text, all of its rows have been compared in full by then.  Rows of a digest that stands for
several texts are joined by the whole text as well.  (No such digest of SHA-256 is
known; the tests use a digest of one letter.)

Defined cases: null ids lose against any other id and stay only if a group has no
other; when several rows share the smallest id and the text, one of them stays
and the rest are reported as dropped; rows whose id and text are both equal share
a salt; extra columns are carried whatever their names, and a column named like an
output column is replaced by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import SPACE, cut, without

SALTS = 32
OUTPUT = ["keep_id", "group_size", "kept", "text_sha256"]


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _keyed(docs: DataFrame, digest) -> DataFrame:
    """Rows (id, text, ...) with their normal text, digest and salt."""
    return (
        docs.withColumn("norm", F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " "))
        .withColumn("digest", digest(F.col("norm")))
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    )


def winners(docs: DataFrame, digest=sha256) -> DataFrame:
    """Narrow rows (digest, salt, norm) of every salted group of (id, text) rows, with the id that stays, the group's size and whether the digest has several texts.

    The text is kept only where it is needed to tell such texts apart, so that the table is small when it is written.
    """
    merged = _keyed(docs.select("id", "text"), digest).groupBy("digest", "salt", "norm").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # The window over the digest comes first: its shuffle serves the other one too.
    texts, same = Window.partitionBy("digest"), Window.partitionBy("digest", "norm")
    several = merged.withColumn("several", F.min("norm").over(texts) != F.max("norm").over(texts))
    won = several.withColumns({"keep_id": F.min("least").over(same), "group_size": F.sum("n").over(same)})
    return cut(won.withColumn("norm", F.when(F.col("several"), F.col("norm"))).drop("least", "n"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = True, digest=sha256) -> DataFrame:
    """One row per document with keep_id, group_size, kept and text_sha256.

    ``carry=False`` returns only the id and the decision, which keeps the text
    out of the last shuffle.
    """
    others = without(docs, OUTPUT) if carry else [docs[f"`{id_col}`"]]
    names = [c for c in docs.columns if c.lower() not in OUTPUT] if carry else [id_col]
    held = [f"c{i}" for i in range(len(names))]
    plain = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), *[c.alias(h) for c, h in zip(others, held, strict=True)])
    keyed, won = _keyed(plain, digest).drop("text"), winners(plain, digest)
    parts = [(keyed.drop("norm").join(won.where("NOT several").drop("norm", "several"), ["digest", "salt"]), ("digest", "salt", "id"))]
    if not won.where("several").isEmpty():
        # The list of digests with several texts is bounded: it is empty unless the digest is broken.
        broken = won.where("several").select("digest").distinct()
        more = keyed.join(F.broadcast(broken), "digest").join(won.where("several").drop("several"), ["digest", "salt", "norm"])
        parts.append((more, ("digest", "salt", "norm", "id")))
    order = F.xxhash64(*held) if carry else F.lit(0)
    out = []
    for joined, keys in parts:
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1
        out.append(
            joined.select(
                *[F.col(h).alias(c) for h, c in zip(held, names, strict=True)],
                "keep_id",
                "group_size",
                (F.col("id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
                F.col("digest").alias("text_sha256"),
            )
        )
    return reduce(DataFrame.unionByName, out)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    where = {c: n for c, n in zip(docs.columns, names, strict=True)}
    kept = decide(docs.toDF(*names), where[id_col], where[text_col]).where("kept")
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decide(docs.select("doc_id", "text"), carry=False)


SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t)
         AND row_number() OVER (PARTITION BY t, doc_id ORDER BY doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
