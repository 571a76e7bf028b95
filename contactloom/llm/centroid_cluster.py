"""Centroid clustering with exact integer arithmetic and partial-distance search.

Every task turns its share of the vectors into integers and compares them with all
centroids.  Squared differences are added up over ``BLOCK`` dimensions at a time, the
dimensions of the highest variance first.  The centroid that is nearest after the first
block is measured in full; each other one is dropped for a vector as soon as its
partial distance is strictly above the vector's best, so ties survive, finish all
dimensions and are decided for the smaller number.  The order of the dimensions changes the
cost, never the result.

A round sends one row per task and centroid (count and sums) to an aggregate, and the
driver gets at most ``k`` rows of it; vectors stay where they are and are read anew in
each round, so nothing but the table itself has to be kept and a lost executor costs its
tasks of one round.  Sums are exact: longs in a task, decimals across tasks.

Defined cases: vectors that are null, of another length than ``DIMENSIONS`` or with a null or
non-finite component are left out; rows that repeat count as often as they occur; a null
id is hashed as the empty text and kept; of rows with equal ids the one with the
smaller components starts first; with fewer vectors than ``k`` there are fewer centroids, and
no vector gives an empty result; components beyond +-2^27 after scaling (131,072 before it)
count as that bound, so that distances fit a long, and a sum of distances stops at the greatest long;
columns other than id and vector are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.shipping import ship

DIMENSIONS = 64
SCALE = 1024
K = 8
ROUNDS = 10
#: Dimensions that are added up before centroids are dropped.
BLOCK = 16
#: Rows that are compared at once.
ROWS = 8192
BOUND = 1 << 27
MOST = (1 << 63) - 1


def _integers(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows that count, their components as integers)."""
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dimensions), False)
    places = np.flatnonzero(right.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(places)).flatten()
    x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    finite = np.isfinite(x).all(axis=1)
    bounded = np.clip(np.floor(x[finite] * SCALE), -BOUND, BOUND)
    return places[finite], bounded.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; ties go to the smaller number."""
    x, centroids = x[:, order], centroids[:, order]
    head = ((x[:, None, :BLOCK] - centroids[None, :, :BLOCK]) ** 2).sum(axis=2)
    best = head.argmin(axis=1)
    rows = np.arange(len(x))
    least = head[rows, best] + ((x[:, BLOCK:] - centroids[best, BLOCK:]) ** 2).sum(axis=1)
    first = best.copy()
    for k, centroid in enumerate(centroids):
        alive = np.flatnonzero((head[:, k] <= least) & (first != k))
        partial = head[alive, k]
        for at in range(BLOCK, x.shape[1], BLOCK):
            partial = partial + ((x[alive, at : at + BLOCK] - centroid[at : at + BLOCK]) ** 2).sum(axis=1)
            stays = partial <= least[alive]
            alive, partial = alive[stays], partial[stays]
        better = (partial < least[alive]) | (k < best[alive])
        best[alive[better]], least[alive[better]] = k, partial[better]
    return best, least


def _slices(batches, dimensions: int):
    """(batch, places, integers) of at most ``ROWS`` rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            places, x = _integers(part.column("v"), dimensions)
            if len(places):
                yield part, places, x


def _moment_batches(dimensions: int):
    def run(batches):
        n, total, square = 0, np.zeros(dimensions), np.zeros(dimensions)
        for _, _, x in _slices(batches, dimensions):
            n, total, square = n + len(x), total + x.sum(axis=0), square + (x.astype(float) ** 2).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"d": np.arange(dimensions), "n": np.full(dimensions, n), "s": total, "q": square})

    return run


def _kept_batches(dimensions: int):
    def run(batches):
        for part, places, x in _slices(batches, dimensions):
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dimensions, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(places)), flat], ["id", "x"])

    return run


def _sum_batches(centroids: np.ndarray, order: np.ndarray):
    def run(batches):
        count, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for _, _, x in _slices(batches, centroids.shape[1]):
            cluster, _ = nearest(x, centroids, order)
            count += np.bincount(cluster, minlength=len(centroids))
            for k in np.unique(cluster):
                sums[k] += x[cluster == k].sum(axis=0)
        met = np.flatnonzero(count)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met]), pa.array(sums[met].tolist(), pa.list_(pa.int64()))], ["k", "n", "s"])

    return run


def _assign_batches(centroids: np.ndarray, order: np.ndarray):
    def run(batches):
        for part, places, x in _slices(batches, centroids.shape[1]):
            cluster, distance = nearest(x, centroids, order)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").take(pa.array(places)), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"]
            )

    return run


class Clustering:
    """Centroids fitted to the vectors of a table, with the same arithmetic at every size."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS):
        self.plain = ship(vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{vector_col}`"].alias("v")))
        self.id_type = self.plain.schema["id"].dataType.simpleString()
        self.k, self.dimensions = k, dimensions
        self.order = self._order()
        self.centroids = self._start()
        for _ in range(rounds if len(self.centroids) else 0):
            self._round()

    def _order(self) -> np.ndarray:
        """Dimensions by falling variance."""
        moments = self.plain.mapInArrow(_moment_batches(self.dimensions), "d long, n long, s double, q double")
        of = {r.d: r.q / r.n - (r.s / r.n) ** 2 for r in moments.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()}
        return np.array(sorted(range(self.dimensions), key=lambda d: (-of.get(d, 0.0), d)))

    def _start(self) -> np.ndarray:
        kept = self.plain.mapInArrow(_kept_batches(self.dimensions), f"id {self.id_type}, x array<long>")
        key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
        first = kept.withColumn("h", key).orderBy("h", "x").limit(self.k).collect()
        return np.array([r.x for r in first], dtype=np.int64).reshape(-1, self.dimensions)

    def _round(self) -> None:
        parts = self.plain.mapInArrow(_sum_batches(self.centroids, self.order), "k int, n long, s array<long>")
        exact = [F.sum(F.col("s")[d].cast("decimal(19,0)")).alias(f"s{d}") for d in range(self.dimensions)]
        for r in parts.groupBy("k").agg(F.sum("n").alias("n"), *exact).collect():
            self.centroids[r.k] = [int(r[f"s{d}"]) // r.n for d in range(self.dimensions)]

    def assign(self) -> DataFrame:
        """(id, cluster, distance) of every vector that counts."""
        if not len(self.centroids):
            return self.plain.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
        return self.plain.mapInArrow(_assign_batches(self.centroids, self.order), f"id {self.id_type}, cluster int, distance long")

    def report(self) -> DataFrame:
        """``assign`` with the inertia of the cluster and of all, and a digest of the cluster's centroid."""
        assigned = self.assign()
        sums = {r.cluster: int(r.d) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("d")).collect()}
        digests = {k: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for k, c in enumerate(self.centroids)}
        look = lambda values, kind: F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[F.col("cluster")].cast(kind) if values else F.lit(None).cast(kind)
        return assigned.withColumns(
            {
                "cluster_inertia": look({k: min(v, MOST) for k, v in sums.items()}, "long"),
                "inertia": F.lit(min(sum(sums.values()), MOST)).cast("long"),
                "centroid_sha256": look(digests, "string"),
            }
        )


def query(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return Clustering(vectors).report().withColumnRenamed("id", "vec_id")


def _sql(k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> str:
    near = "SELECT i, min(d) AS d, arg_min(k, {{d: d, k: k}}) AS k FROM (SELECT v.i, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c USING (dim) GROUP BY 1, 2) GROUP BY 1"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        if r < rounds:
            mean = "(sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(
                f"m{r} AS (SELECT a.k, dim, {mean} AS x FROM v JOIN a{r} a USING (i) GROUP BY 1, 2), "
                f"c{r + 1} AS MATERIALIZED (SELECT c.k, c.dim, coalesce(m.x, c.x)::BIGINT AS x FROM c{r} c LEFT JOIN m{r} m ON m.k = c.k AND m.dim = c.dim)"
            )
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT)) - 1 AS i,
         vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS z
  FROM embeddings WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT i, unnest(range({dimensions})) AS dim, unnest(z) AS x FROM kept
), c0 AS (
  SELECT i AS k, dim, x FROM v WHERE i < {k}
), {", ".join(steps)}
SELECT vec_id, k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       (SELECT sha256(string_agg(c.x::VARCHAR, ',' ORDER BY dim)) FROM c{rounds} c WHERE c.k = a.k) AS centroid_sha256
FROM a{rounds} a JOIN kept USING (i)
"""


SQL = _sql()
