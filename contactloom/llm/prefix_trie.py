"""Trie of conversation prefixes by smallest-member ownership.

A node is a distinct sequence of first turns and belongs to its smallest member.  The
members of a node's child are members of the node, so a conversation that is the smallest
member at one depth is so at all greater ones: every conversation owns a suffix of its
path.  Windows mark the owned nodes.  Sums over a node's subtree then need no walk: all
turns that its members have from that depth on (occurrences) contain each node of the
subtree once per member, and those that their owners own contain it once, so

    sum of (members - 1) * bytes  =  bytes of occurrences - bytes of owned turns,

a leaf counts once if its owner flags it, a child once if its owner owns it.  One group-by
over prefixes adds these up.

A prefix is known by its depth and 128 bits: the exclusive or of one hash for each of its turns, taken
of the place and the SHA-256 of role and text.  It is a running window, so no row holds a
whole prefix, and texts are left behind after their digest and size are taken.

Skew.  Rows are dealt by ranges of (conversation, turn), and running values are taken per
range or per ``SLICE`` turns and moved by the totals before, so a conversation of most turns
is spread over tasks.  The members of a node are dealt by salts, as many as the number of
conversations asks for; a first window finds the smallest of each salt, a second one
the smallest of those; every other step combines before it shuffles or joins on (conversation,
slice).  Only the digest of the conversations that end at a node is made in one task, since SHA-256 is
sequential; it streams sorted ids and holds one batch of them.

Defined cases: turns are ordered with null first, equal turns by the digest of role and
text, rows that repeat are turns of their own; null roles and texts are empty and differ in no way
from empty ones; rows without a conversation id belong to none and are left out; the remainder of
a negative id has its sign; an empty table has no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.llm.common import cut
from contactloom.shipping import ship

#: Conversations of one family share the first turns of the one whose id it can be divided by.
FAMILY = 5
#: Values of the number of shared turns.
SHARED = 9
#: Turns of one conversation that a task numbers and adds up together.
SLICE = 65_536
#: Members of one node that a task compares.
MEMBERS = 50_000
NODE = ["depth", "x1", "x2"]


def numbered(conversations: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """(c, part, p, g, size): the turns of every conversation, numbered from 1, with their digest and the bytes of their text.

    ``part`` is the range of rows that a turn fell in; a conversation has few of them.
    """
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), "turn", digest.alias("g"), F.octet_length(text).cast("long").alias("size")
    )
    ranged = cut(narrow.repartitionByRange("c", "turn", "g").withColumn("part", F.spark_partition_id()))
    return ranged.withColumn("p", F.row_number().over(Window.partitionBy("c", "part").orderBy("turn", "g")).cast("long")).drop("turn")


def _families(rows: DataFrame, shared: Column) -> DataFrame:
    """One row for every range ``part`` of every conversation: the turns before it, how many are shared, and from whom.

    ``h`` turns are asked for, ``k`` of them exist, and the rebuilt conversation has ``len``.
    """
    parts = rows.groupBy("c", "part").agg(F.count("*").alias("n_part"))
    before, whole = Window.partitionBy("c").orderBy("part"), Window.partitionBy("c")
    placed = parts.withColumns({"start": F.sum("n_part").over(before) - F.col("n_part"), "n": F.sum("n_part").over(whole)})
    first = placed.where("start = 0").select("c", "n").withColumn("source", F.col("c") - F.col("c") % FAMILY).withColumn("h", shared)
    sources = first.where("c = source").select(F.col("c").alias("source"), F.col("n").alias("n_source"))
    k = F.least("h", F.coalesce("n_source", F.lit(0)))
    sized = first.join(sources, "source", "left").select("c", "source", "h", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    return placed.select("c", "part", "start").join(sized, "c")


def rebuilt(conversations: DataFrame, shared: Column | None = None) -> DataFrame:
    """(c, depth, g, size, len): the turns of the rebuilt conversations; depth 0 is the root's row.

    ``shared`` is the number of turns that a conversation ``c`` takes from its family's first one.
    """
    shared = F.crc32(F.col("c").cast("string")) % SHARED if shared is None else shared
    rows = numbered(conversations)
    info = cut(_families(rows, shared.cast("long")))
    placed = rows.join(info, ["c", "part"]).withColumn("p", F.col("p") + F.col("start"))
    tails = placed.where("p > h").select("c", (F.col("p") - F.col("h") + F.col("k")).alias("depth"), "g", "size", "len")
    once = info.where("start = 0")
    givers = placed.where((F.col("p") < SHARED) & (F.col("c") % FAMILY == 0)).select(F.col("c").alias("source"), F.col("p").alias("depth"), "g", "size")
    heads = once.join(givers, "source").where("depth <= k").select("c", "depth", "g", "size", "len")
    roots = once.select("c", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("g"), F.lit(0).cast("long").alias("size"), "len")
    return tails.unionByName(heads).unionByName(roots)


def paths(turns: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """``turns`` without their digests, with the prefix (x1, x2), the parent's prefix (px1, px2), and the bytes ``before`` the turn."""
    own = lambda lane: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(lane), "depth", "g"))
    hashed = turns.select("c", "depth", "size", "len", own(1).alias("o1"), own(2).alias("o2")).withColumn("slice", F.floor(F.col("depth") / slice_rows))
    so_far = Window.partitionBy("c", "slice").orderBy("depth")
    local = hashed.withColumns({"x1": F.bit_xor("o1").over(so_far), "x2": F.bit_xor("o2").over(so_far), "upto": F.sum("size").over(so_far)})
    totals = hashed.where(F.col("len") >= slice_rows).groupBy("c", "slice").agg(F.bit_xor("o1").alias("t1"), F.bit_xor("o2").alias("t2"), F.sum("size").alias("t"))
    earlier = Window.partitionBy("c").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    moves = totals.select("c", "slice", F.bit_xor("t1").over(earlier).alias("m1"), F.bit_xor("t2").over(earlier).alias("m2"), F.sum("t").over(earlier).alias("m"))
    zero = F.lit(0).cast("long")
    moved = local.join(moves.where("slice > 0"), ["c", "slice"], "left").withColumns(
        {
            "x1": F.col("x1").bitwiseXOR(F.coalesce("m1", zero)),
            "x2": F.col("x2").bitwiseXOR(F.coalesce("m2", zero)),
            "before": F.col("upto") - F.col("size") + F.coalesce("m", zero),
        }
    )
    parent = {f"px{i}": F.col(f"x{i}").bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)}
    return moved.withColumns(parent).select("c", "depth", "slice", "size", "len", "before", "x1", "x2", "px1", "px2")


def _smallest(occurrences: DataFrame, salts: int) -> DataFrame:
    """The smallest member of every salt of every node, with the node's ``owner`` and the length ``deepest`` of its longest member."""
    salted = occurrences.withColumn("salt", F.pmod(F.xxhash64("c"), F.lit(salts)).cast("int"))
    cell, node = Window.partitionBy(*NODE, "salt"), Window.partitionBy(*NODE)
    winners = salted.withColumns({"low": F.min("c").over(cell), "deep": F.max("len").over(cell)}).where("c = low")
    return winners.withColumns({"owner": F.min("c").over(node), "deepest": F.max("deep").over(node)}).drop("low", "deep")


def _owners(occurrences: DataFrame, salts: int, slice_rows: int) -> DataFrame:
    """One row for every slice of every conversation: the depth from which it owns its path, the bytes before, that node's parent, and whether it ends at a leaf of its own."""
    smallest = cut(_smallest(occurrences, salts))
    owned = smallest.where("c = owner")
    above = smallest.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("px1"), F.col("x2").alias("px2"), "salt", F.col("owner").alias("parent"))
    marks = owned.join(above, ["depth", "px1", "px2", "salt"], "left").select(
        "c", F.struct("depth", "before", "parent").alias("top"), ((F.col("depth") == F.col("len")) & (F.col("deepest") == F.col("depth"))).alias("leaf"), F.lit(None).cast("long").alias("total"), "len"
    )
    ends = occurrences.where("depth = len").select("c", F.lit(None).cast(marks.schema["top"].dataType).alias("top"), F.lit(False).alias("leaf"), (F.col("before") + F.col("size")).alias("total"), "len")
    each = marks.unionByName(ends).groupBy("c").agg(F.min("top").alias("top"), F.max("leaf").alias("leaf"), F.max("total").alias("total"), F.max("len").alias("n"))
    return each.select(
        "c",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / slice_rows))).alias("slice"),
        F.coalesce("top.depth", F.col("n") + 1).alias("own_from"),
        F.coalesce("top.before", "total").alias("head"),
        F.col("top.parent").alias("parent"),
        F.col("leaf").cast("long").alias("leaf"),
    )


def _end_batches(batches):
    """SHA-256 of the joined ids of each run of equal nodes; a run may go on in the next batch."""
    open_key, state, done = None, None, []

    def out():
        columns = list(zip(*done, strict=True)) if done else [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NODE, "ends_sha256"])
        done.clear()
        return batch

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.asarray(batch.column(n)) for n in NODE], axis=1)
        ids = batch.column("c").to_pylist()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key, text = tuple(keys[a].tolist()), ",".join(map(str, ids[a:b])).encode()
            if key == open_key:
                state.update(b"," + text)
                continue
            if state is not None:
                done.append((*open_key, state.hexdigest()))
            open_key, state = key, hashlib.sha256(text)
        yield out()
    if state is not None:
        done.append((*open_key, state.hexdigest()))
        yield out()


def trie(turns: DataFrame, slice_rows: int = SLICE, members: int = MEMBERS) -> DataFrame:
    """One row per node of the trie of ``turns`` (c, depth, g, size, len)."""
    occurrences = cut(paths(turns, slice_rows))
    ends = occurrences.where("depth = len").select(*NODE, "c")
    salts = max(8, ends.count() // members)
    rows = occurrences.join(_owners(occurrences, salts, slice_rows), ["c", "slice"])
    mine = F.col("depth") >= F.col("own_from")
    nodes = rows.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"),
        F.max(F.when(mine, F.when(F.col("depth") == F.col("own_from"), F.col("parent")).otherwise(F.col("c")))).alias("parent_conv_id"),
        F.count("*").alias("n_convs"),
        F.sum(((F.col("depth") < F.col("len")) & (F.col("depth") + 1 >= F.col("own_from"))).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("head") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    digests = ship(ends).repartition(*NODE).sortWithinPartitions(*NODE, "c").mapInArrow(_end_batches, "depth long, x1 long, x2 long, ends_sha256 string")
    return nodes.join(digests, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def query(spark, sf_dir):
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))
), t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT c, g, strlen(text) AS size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS p FROM t
), n AS (
  SELECT c, count(*) AS n, c - c % 5 AS source FROM p GROUP BY c
), h AS (
  SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                              lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h FROM n, crc
), k AS (
  SELECT h.c, h.source, h.h, least(h.h, coalesce(s.n, 0)) AS k FROM h LEFT JOIN n s ON s.c = h.source
), r AS (
  SELECT k.c, p.p AS d, p.g, p.size FROM k JOIN p ON p.c = k.source AND p.p <= k.k
  UNION ALL SELECT k.c, p.p - k.h + k.k, p.g, p.size FROM k JOIN p ON p.c = k.c AND p.p > k.h
  UNION ALL SELECT c, 0, '', 0 FROM k
), o AS (
  SELECT c, d, size, sha256(string_agg(g, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS key, max(d) OVER (PARTITION BY c) AS len FROM r
), node AS (
  SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size, max(len) > d AS inner_node,
         sha256(coalesce(string_agg(CASE WHEN len = d THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM o GROUP BY d, key
), up AS (
  SELECT o.d, o.key, sum((u.n_convs - 1) * u.size) AS saved_tokens, sum((NOT u.inner_node)::INT) AS n_leaves, sum((u.d = o.d + 1)::INT) AS n_children
  FROM node u JOIN o ON o.c = u.conv_id AND o.d <= u.d GROUP BY o.d, o.key
), parent AS (
  SELECT node.d, node.key, a.conv_id AS parent_conv_id
  FROM node JOIN o ON o.c = node.conv_id AND o.d = node.d - 1 JOIN node a ON a.d = o.d AND a.key = o.key
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM node JOIN up USING (d, key) LEFT JOIN parent USING (d, key)
"""
