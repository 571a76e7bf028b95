"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source is expected ``target / source size`` times (at most
twice).  Documents of a source are laid out by size class, inside a class by a
hash; expected copies are prefix-summed along that order, one offset per source is
added, and a document is emitted once for every integer boundary its interval
crosses.  The layout by size class makes the taken words follow the target.

Prefix sums are taken on three levels, (source), (source, class) and (source,
class, slice), where a class is one of at most 2,048 size ranges and a slice one of
256 hash ranges.  No window holds more than 2,048 classes, 256 slices or the
documents of one slice, so a source with a third of all rows needs no single task.

Defined cases: null texts have size 0; a null source is a source of its own and
comes last; sources without words, and empty tables, have target 0 and nothing is
taken; equal and null ids are told apart by their text, and only rows that repeat in
both share a slice whatever their number; extra columns are carried, and a column named
like an output column is replaced by it in ``plan``.

The words taken of a source differ from its target by less than twice the words of its
longest document (documents are whole, so no mixture comes closer than half of that).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = "mix"
OUTPUT = ["size", "source_size", "target", "copies", "taken"]
_KEYS = ["__source", "__null", "__class", "__slice"]


def _laid_out(docs: DataFrame, seed: str) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    text_hash = F.md5(F.coalesce(F.col("text"), F.lit("")))
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_hash))
    return (
        docs.withColumn("size", size)
        .withColumn("__source", F.coalesce(F.col("source").cast("string"), F.lit("")))
        .withColumn("__null", F.col("source").isNull())
        .withColumn(
            "__class",
            F.expr("CASE WHEN size < 32 THEN size ELSE length(bin(size)) * 32L + shiftright(size, length(bin(size)) - 6) END"),
        )
        .withColumn("__hash", hashed)
        .withColumn("__slice", F.substring("__hash", 1, 2))
    )


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, null flag, source_size) rows with their target.

    Sharing by weight with a ceiling and resharing the excess ends where every
    source has the smaller of ``level * weight`` and its ceiling; the level follows
    from prefix sums over the sources ordered by ceiling per weight.  The table has
    one row per source.
    """
    order = Window.orderBy("__null", "__source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn(
        "weight", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    ).withColumn("ceiling", F.col("source_size") * float(limit))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("ceiling") / F.col("weight"), "__null", "__source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    level = ranked.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("budget"),
        F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)).alias("full"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("left"),
    ).withColumn("level", (F.col("budget") - F.col("full")) / F.col("left"))
    # Levels fall along the order once one fits below its source's ceiling: the first fitting one is the largest.
    fits = F.col("level") * F.col("weight") <= F.col("ceiling")
    return level.withColumn("level", F.max(F.when(fits, F.col("level"))).over(everything)).select(
        "__source",
        "__null",
        "source_size",
        F.when(F.col("source_size") == 0, 0.0)
        .otherwise(F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("ceiling")), "ceiling"))
        .alias("target"),
    )


def plan(docs: DataFrame, seed: str = SEED, carry: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken.

    ``carry=False`` leaves out the text, so that texts are read once and only narrow rows are laid out.
    """
    laid = _laid_out(docs.drop(*OUTPUT), seed)
    if not carry:
        laid = cut(laid.drop("text"))
    cells = laid.groupBy(*_KEYS).agg(F.count("*").alias("__n"), F.sum("size").alias("__words"))
    classes = cells.groupBy(*_KEYS[:3]).agg(F.sum("__n").alias("__n"), F.sum("__words").alias("__words"))
    sources = classes.groupBy(*_KEYS[:2]).agg(F.sum("__words").alias("source_size"))
    prior = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    of_class = classes.select(
        *_KEYS[:3], F.coalesce(F.sum("__n").over(prior(_KEYS[:2], "__class")), F.lit(0)).alias("__classes")
    ).join(targets(sources), _KEYS[:2])
    of_cell = cells.select(
        *_KEYS, F.coalesce(F.sum("__n").over(prior(_KEYS[:3], "__slice")), F.lit(0)).alias("__slices")
    ).join(of_class, _KEYS[:3])
    place = Window.partitionBy(*_KEYS).orderBy("__hash")
    placed = laid.withColumn("__in", F.row_number().over(place)).join(of_cell, _KEYS)
    rank = F.col("__classes") + F.col("__slices") + F.col("__in")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(
        F.substring(F.md5(F.concat(F.lit(f"{seed}/"), "__source", F.col("__null").cast("string"))), 1, 8), 16, 10
    ).cast("double") / float(2**32)
    copies = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return placed.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop(
        *_KEYS, "__hash", "__in", "__classes", "__slices"
    )


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixture: every document as often as it is taken, with the columns of ``docs``."""
    need = ("doc_id", "text", "source")
    names = {c: (c if c in need else f"c{i}") for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in names.items()])
    taken = plan(plain, seed).where("copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        *[F.col(a).alias(c) for c, a in names.items()]
    )


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan(docs.select("doc_id", "text", "source"), carry=False).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS z, coalesce(source, '') AS s, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix:', doc_id::VARCHAR, ':', md5(coalesce(text, '')))) AS h
  FROM documents
), k AS (
  SELECT *, CASE WHEN size < 32 THEN size ELSE length(bin(size)) * 32 + (size >> (length(bin(size)) - 6)) END AS class FROM d
), q AS (
  SELECT z, s, sum(size)::BIGINT AS source_size FROM k GROUP BY z, s
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY z, s) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size::DOUBLE * 2.0::DOUBLE AS ceiling FROM q
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, z, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / (sum(weight) OVER ()
             - coalesce(sum(weight) OVER (ORDER BY ceiling / weight, z, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM w
), m AS (
  SELECT *, max(CASE WHEN level * weight <= ceiling THEN level END) OVER () AS lv FROM l
), t AS (
  SELECT z, s, source_size,
         CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(coalesce(lv * weight, ceiling), ceiling) END AS target FROM m
), r AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         row_number() OVER (PARTITION BY k.z, k.s ORDER BY k.class, k.h) AS rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5(concat('mix/', k.s, CASE WHEN k.z THEN 'true' ELSE 'false' END)), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM k JOIN t ON k.z = t.z AND k.s = t.s
)
SELECT doc_id, size, source_size, target,
       ((floor(rank * rate + u) - floor((rank - 1) * rate + u))::BIGINT * size)::BIGINT AS taken
FROM r
"""
