"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import cut

MAX_ROUNDS = 60
#: Parts into which the links of one node are dealt.
SALTS = 32


def _beside_least(links: DataFrame, least: Column) -> DataFrame:
    """``links`` (a, b) with ``m``, the least neighbour of a.

    The root of a giant component has as many links as the component has nodes, so links
    are dealt by (a, salt of b), and the least of every node goes to all salts.
    """
    salt = F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")
    mins = links.groupBy("a").agg(least.alias("m"))
    spread = mins.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return links.withColumn("salt", salt).join(spread, ["a", "salt"]).drop("salt")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the smallest node reachable.

    Nodes may be of any type that has an order, such as structs.  Each round links every
    node's larger neighbours to its smallest neighbour (large star), then its smaller
    neighbours too (small star), and checkpoints the links.  Rounds end when the links no longer change, which is a star per
    component; their number grows with the logarithm of the longest chain.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = cut(edges), None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.hash("a", "b"), F.lit(65521)))).first()
        if state[0] == 0 or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _beside_least(both, F.least(F.min("b"), F.col("a"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _beside_least(large, F.min("b")).select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        )
        edges = cut(small.select("e.*").where("a <> b").distinct())
    raise RuntimeError("the components did not settle")
