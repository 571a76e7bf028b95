"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at Hamming distance 4 or less have a common variant at distance
2 or less from both, so fingerprints that share a variant of their balls of radius
2 are exactly the linked ones.  Every distinct fingerprint emits its whole ball
(2,081 variants).  The shuffle key is a prefix of the variant: a fingerprint is sent
once for every way to change at most two prefix bits, together with the number of
changes left, and the receiving task expands the changes of the other bits.  That
moves the same ball in a few dozen rows instead of 2,081.

In a task, equal variants are found by sorting.  All fingerprints of one variant
are within distance 4 of each other, so each is linked to the smallest of them; the
links are verified by their bit count and deduplicated.  Pairs of a group of copies
are never enumerated: exact copies share one fingerprint, and a ball of radius 4 has
a bounded number of fingerprints.

A fingerprint stands for its best row, the one of the smallest id, and the best row of
all fingerprints reachable is the root of its component, so a component's id needs no
further lookup.  Rows get it by (fingerprint, salt of the id), so copies that share one
fingerprint are dealt over ``SALTS`` tasks.

Defined cases: null and blank texts have fingerprint zero and are linked like any
other; ids may have any type that has an order; null ids do not become a component's id
unless there is no other; rows that repeat are kept apart by ``decide``, which ignores
columns other than id and text; extra columns, whatever their names, are carried by
``keep_one``.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import cut
from contactloom.llm.graph import components
from contactloom.shipping import ship

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Variants that a task sorts at once.
CHUNK = 4_000_000
SALTS = 32


def shingle_hashes(text: bytes | None) -> list[int]:
    """XXH64 of the lower-cased word shingles of a text (bytes.split knows ASCII white space only)."""
    found = (text or b"").lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    if len(found) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in found)]
    starts = [0, *(e + 1 for e in ends)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    return [digest(joined[s:e], seed) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)]


def majority(hashes: list[int]) -> int:
    """The fingerprint: bits set in over half of the hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    if n == 1:
        return hashes[0]
    rows = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8), bitorder="little").reshape(n, 64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 255):
        counts += np.add.reduce(rows[i : i + 255], axis=0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = np.fromiter((majority(shingle_hashes(t.as_py())) for t in texts), dtype=np.uint64, count=len(texts))
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(prints.view(np.int64))], [*kept, "fp"])


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, the carried columns, fp) with the fingerprint as a signed 64-bit integer."""
    kept = docs.select("doc_id", *carried, "text")
    return ship(kept).mapInArrow(_fingerprint_batches, kept.drop("text").schema.add("fp", "long"))


def _flips(bits: list[int], most: int) -> list[tuple[int, int]]:
    """(mask, changes) of all ways to change at most ``most`` of the bits."""
    one = [(1 << b, 1) for b in bits] if most >= 1 else []
    two = [((1 << b) | (1 << c), 2) for i, b in enumerate(bits) for c in bits[:i]] if most >= 2 else []
    return [(0, 0), *one, *two]


def _send(prefix: int):
    """Rows (bucket, fp, left) of every prefix that a variant of the ball can have."""
    shift = 64 - prefix
    flips = _flips(list(range(shift, 64)), RADIUS // 2)
    masks = np.array([m for m, _ in flips], dtype=np.uint64)
    left = np.array([RADIUS // 2 - k for _, k in flips], dtype=np.int8)

    def run(batches):
        for batch in batches:
            every = np.asarray(batch.column("fp")).view(np.uint64)
            for i in range(0, len(every), 4096):
                fp = every[i : i + 4096]
                bucket = ((fp[:, None] ^ masks[None, :]) >> np.uint64(shift)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket.ravel()),
                        pa.array(np.repeat(fp, len(masks)).view(np.int64)),
                        pa.array(np.tile(left, len(fp))),
                    ],
                    ["bucket", "fp", "left"],
                )

    return run


def _meet(key: np.ndarray, fp: np.ndarray, left: np.ndarray, free: int, out: list) -> None:
    """Links of the fingerprints whose variants agree with ``key`` and meet in the ``free`` low bits.

    A variant is (key with the prefix bits of the bucket, low bits of fp with at
    most ``left`` changes).  Too large a set is split by four more prefix bits.
    """
    size = sum(int((left == k).sum()) * n for k, n in ((0, 1), (1, 1 + free), (2, 1 + free + free * (free - 1) // 2)))
    if len(fp) < 2:
        return
    if size > CHUNK and free > 4:
        low = free - 4
        flips = _flips(list(range(low, free)), 2)
        parts = []
        for mask, k in flips:
            ok = left >= k
            parts.append((key[ok] ^ np.uint64(mask), fp[ok], left[ok] - k))
        keys, fps, lefts = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = (keys >> np.uint64(low)) & np.uint64(15)
        for v in range(16):
            ok = place == v
            _meet(keys[ok], fps[ok], lefts[ok], low, out)
        return
    variants, owners = [key], [np.arange(len(fp))]
    for k, most in ((1, 1), (2, 2)):
        ok = np.flatnonzero(left >= k)
        masks = np.array([m for m, c in _flips(list(range(free)), most) if c == most], dtype=np.uint64)
        if len(ok) and len(masks):
            variants.append((key[ok][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(ok, len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(variant)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return
    at = np.searchsorted(twice, variant)
    at[at == len(twice)] = 0
    hit = twice[at] == variant
    group, member = at[hit], fp[owner[hit]]
    order = np.lexsort((member, group))
    group, member = group[order], member[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    centre = np.repeat(member[first], np.diff(np.r_[first, len(group)]))
    linked = (centre != member) & (np.bitwise_count(centre ^ member) <= RADIUS)
    if linked.any():
        out.append(np.unique(np.stack([centre[linked], member[linked]], axis=1), axis=0))


def _receive(prefix: int):
    """Links (a, b) of a task's buckets.  A task holds its share of the sent rows, 17 bytes each."""
    free = 64 - prefix

    def run(batches):
        got = [tuple(np.asarray(b.column(c)) for c in ("bucket", "fp", "left")) for b in batches]
        if not got:
            return
        bucket, fp, left = (np.concatenate(x) for x in zip(*got, strict=True))
        del got
        order = np.argsort(bucket, kind="stable")
        bucket, fp, left = bucket[order], fp[order].view(np.uint64), left[order]
        low = np.uint64((1 << free) - 1)
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        # Buckets are taken together up to the chunk size: the bucket is part of the key.
        key = (bucket.astype(np.uint64) << np.uint64(free)) | (fp & low)
        sizes = np.choose(left, [1, 1 + free, 1 + free + free * (free - 1) // 2])
        total = np.r_[0, np.cumsum(sizes)]
        i = 0
        while i < len(edges) - 1:
            j = max(i + 1, int(np.searchsorted(total[edges], total[edges[i]] + CHUNK, side="right")) - 1)
            part = slice(edges[i], edges[j])
            found: list = []
            _meet(key[part], fp[part], left[part], free, found)
            for links in found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(links[:, 0].copy().view(np.int64)), pa.array(links[:, 1].copy().view(np.int64))], ["a", "b"]
                )
            i = j

    return run


def prefix_bits(n: int) -> int:
    """Prefix length that leaves about 2,000 fingerprints a bucket, from 8 to 20 bits."""
    return min(20, max(8, math.ceil(math.log2(max(n, 1) / 2000))))


def links(prints: DataFrame, n: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp); their components are those of all linked pairs."""
    prefix = prefix_bits(n)
    sent = prints.mapInArrow(_send(prefix), "bucket long, fp long, left byte")
    return sent.repartition(F.col("bucket")).mapInArrow(_receive(prefix), "a long, b long").distinct()


def _rooted(distinct: DataFrame) -> DataFrame:
    """(fp, best) of every distinct fingerprint, with the best row of its whole component; ``distinct`` is read more than once."""
    found = links(distinct.select("fp"), distinct.count())
    node = lambda side: distinct.select(F.col("fp").alias(f"fp_{side}"), F.struct("best", "fp").alias(side))
    named = found.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).join(node("a"), "fp_a").join(node("b"), "fp_b")
    roots = components(named.select("a", "b")).select(F.col("node.fp").alias("fp"), F.col("root.best").alias("root"))
    return distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "best").alias("best"))


def _salt(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def decide(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), one row per document."""
    prints = cut(fingerprints(docs)).withColumn("salt", _salt("doc_id"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")
    cells = prints.groupBy("fp", "salt").agg(F.min(rank).alias("best"))
    rooted = _rooted(cut(cells.groupBy("fp").agg(F.min("best").alias("best"))))
    of_cell = cells.select("fp", "salt").join(rooted, "fp").select("fp", "salt", F.col("best.doc_id").alias("component_id"))
    return prints.join(of_cell, ["fp", "salt"]).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component: the one of the smallest id (null ids last), then of the smallest row hashes.

    A row is known by two hashes of all its columns, never by its id, which rows
    of other components can share.  Of rows that repeat in all columns one stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    hashed = docs.toDF(*names).withColumns({"__h": F.xxhash64(*names), "__g": F.xxhash64(F.lit(SEED), *names)})
    where = {n: names[docs.columns.index(n)] for n in ("doc_id", "text")}
    prints = fingerprints(hashed.select(*[F.col(c).alias(n) for n, c in where.items()], "__h", "__g"), "__h", "__g")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__h", "__g")
    rooted = _rooted(cut(prints.groupBy("fp").agg(F.min(rank).alias("best"))))
    keepers = rooted.select("best.__h", "best.__g").distinct()
    once = hashed.dropDuplicates(["__h", "__g"]).join(keepers, ["__h", "__g"], "left_semi")
    return once.select(*[F.col(a).alias(c) for a, c in zip(names, docs.columns, strict=True)])


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decide(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
