"""BAM files as splittable, sorted and indexed tables.

Reading.  A file is cut into ranges of its compressed bytes, whatever its size.  A task finds
the first block at or after its range's start, then the first record that starts in it, and
reads on to the last record that starts in a block of its range; so every record belongs to
one range, also where it runs over blocks or ranges.  A record's start is the first place
from which a chain of records with valid fields leads to the end of the bytes looked at.
Fields are parsed for many records at once; a task holds a window of a few megabytes.

Writing.  Records are dealt by ranges of (chromosome, position) and sorted in their
task, which writes one file and its index (the BAI format: chunks by bin and the least
offset of every window of 16,384 bases).  Files appear under their last name when they are complete, and
the list of files is written last.

Region reads look into the indexes and open only the blocks between the offsets they name.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.shipping import ship

#: Compressed bytes of one range.
SPLIT = 64 << 20
#: Uncompressed bytes that a task parses at once.
WINDOW = 4 << 20
#: Uncompressed bytes of a block that is written.
BLOCK = 0xFF00
#: Records of a file, about 100 bytes each, where the number of files is not given.
RECORDS = 1_000_000
#: Bases of a window of the linear index, as a shift.
LINEAR = 14
# Fixed values of the format: the end-of-file block, the operations of a CIGAR, the sizes of a tag's values.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPERATIONS = "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
TAGS = ("TC", "S1", "S2", "E1", "E2", "E3", "E4")
_MAGIC = b"\x1f\x8b\x08\x04"


# ---------------------------------------------------------------- blocks


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address as Spark writes it, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("s3a:"):
        uri = "s3" + uri[3:]
    return (fs.LocalFileSystem(), uri) if "://" not in uri else fs.FileSystem.from_uri(uri)


def compressed_block(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    head = _MAGIC + bytes(4) + b"\x00\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def block_size(head: bytes) -> int | None:
    """Bytes of the block that starts with ``head``, if one does."""
    if len(head) < 18 or head[:4] != _MAGIC:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= min(12 + extra, len(head)):
        size = struct.unpack_from("<H", head, at + 2)[0]
        if head[at : at + 2] == b"BC" and size == 2 and at + 6 <= len(head):
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def inflated(block: bytes) -> bytes:
    start = 12 + struct.unpack_from("<H", block, 10)[0]
    data = zlib.decompress(block[start:-8], -15)
    check, size = struct.unpack_from("<II", block, len(block) - 8)
    if size != len(data) or check != zlib.crc32(data):
        raise ValueError("a block is damaged")
    return data


class Blocks:
    """The blocks of an open file, read ahead in pieces of a megabyte; ``read`` counts the bytes that were asked for."""

    def __init__(self, handle, size: int, ahead: int = 1 << 20):
        self.handle, self.size, self.ahead = handle, size, ahead
        self.at, self.held, self.read = 0, b"", 0

    def bytes_at(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.handle.seek(at)
            self.at, self.held = at, self.handle.read(min(max(n, self.ahead), self.size - at))
            self.read += len(self.held)
        return self.held[at - self.at : at - self.at + n]

    def find(self, at: int) -> int | None:
        """The first block at or after ``at``: its header must lead to another block or to the end."""
        while at < self.size:
            part = self.bytes_at(at, min(1 << 17, self.size - at))
            hit = part.find(_MAGIC)
            while hit >= 0:
                size = block_size(part[hit : hit + 512])
                after = at + hit + (size or 0)
                if size and (after == self.size or (after < self.size and block_size(self.bytes_at(after, min(512, self.size - after))))):
                    return at + hit
                hit = part.find(_MAGIC, hit + 1)
            if len(part) < 4 or at + len(part) >= self.size:
                return None
            at += len(part) - 3
        return None

    def block(self, at: int) -> tuple[bytes, int] | None:
        """(data, place of the next block)."""
        if at >= self.size:
            return None
        size = block_size(self.bytes_at(at, min(512, self.size - at)))
        if size is None:
            raise ValueError(f"no block at byte {at}")
        return inflated(self.bytes_at(at, size)), at + size


def references(blocks: Blocks) -> tuple[list[str], list[int], int, int]:
    """(names, lengths, block of the first record, place in it)."""
    data, at, starts = b"", 0, []

    def need(n: int) -> None:
        nonlocal data, at
        while len(data) < n:
            got = blocks.block(at)
            if got is None:
                raise ValueError("the header is cut off")
            starts.append((len(data), at))
            data, at = data + got[0], got[1]

    need(12)
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    place = 8 + struct.unpack_from("<i", data, 4)[0]
    need(place + 4)
    count = struct.unpack_from("<i", data, place)[0]
    place += 4
    names, lengths = [], []
    for _ in range(count):
        need(place + 4)
        size = struct.unpack_from("<i", data, place)[0]
        need(place + 8 + size)
        names.append(data[place + 4 : place + 3 + size].decode())
        lengths.append(struct.unpack_from("<i", data, place + 4 + size)[0])
        place += 8 + size
    if place == len(data):
        return names, lengths, at, 0
    offset, block = max(s for s in starts if s[0] <= place)
    return names, lengths, block, place - offset


# ---------------------------------------------------------------- records


def _ints(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Little-endian 32-bit integers at any places."""
    return data[at[:, None] + np.arange(4)].view("<i4")[:, 0]


def _valid(data: bytes, at: int, n_refs: int) -> int | None:
    """The place after the record at ``at`` if its fields are possible; -1 if the bytes end before that can be said."""
    if at + 36 > len(data):
        return -1
    size, ref, pos, n_name, _, _, n_ops, _, n_seq, other, other_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    least = 32 + n_name + 4 * n_ops + (n_seq + 1) // 2 + n_seq
    if size < least or not n_name or n_seq < 0 or not (-1 <= ref < n_refs and -1 <= other < n_refs and pos >= -1 and other_pos >= -1):
        return None
    end = at + 35 + n_name
    if end < len(data) and (data[end] != 0 or 0 in data[at + 36 : end]):
        return None
    return at + 4 + size


def first_record(data: bytes, upto: int, n_refs: int, last: bool) -> int | None:
    """The first place before ``upto`` from which records lead to the end of ``data``.

    ``last`` tells that the file ends there, so that the chain must end with it.
    """
    raw = np.frombuffer(data, np.uint8)
    places = np.arange(max(0, min(upto, len(raw) - 36)))
    if not len(places):
        return None
    size, ref, other = (_ints(raw, places + k) for k in (0, 4, 24))
    for at in places[(size >= 33) & (ref >= -1) & (ref < n_refs) & (other >= -1) & (other < n_refs) & (raw[places + 12] > 0)].tolist():
        here: int | None = at
        while here is not None and 0 <= here < len(data):
            here = _valid(data, here, n_refs)
        if here is not None and (not last or here == len(data)):
            return at
    return None


def windows(blocks: Blocks, n_refs: int, first: tuple[int, int], start: int, stop: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """(data, places of records) for all records that start in blocks of [start, stop)."""
    at, place = first
    if start > first[0]:
        found = blocks.find(start)
        while found is not None and found < stop:
            data, after = blocks.block(found)
            upto, further = len(data), after
            while len(data) < upto + 4 * BLOCK and (more := blocks.block(further)) is not None:
                data, further = data + more[0], more[1]
            record = first_record(data, upto, n_refs, further >= blocks.size)
            if record is not None:
                break
            found = after if after < blocks.size else None
        if found is None or found >= stop:
            return
        at, place = found, record
    data, limit = b"", None
    while True:
        while len(data) < place + WINDOW and limit is None:
            if at >= stop or (got := blocks.block(at)) is None:
                limit = len(data)
            else:
                data, at = data + got[0], got[1]
        places = []
        end = len(data) if limit is None else limit
        while place < end:
            while limit is not None and len(data) < place + 4 or (limit is not None and place + 4 + struct.unpack_from("<i", data, place)[0] > len(data)):
                got = blocks.block(at)
                if got is None:
                    raise ValueError("the last record is cut off")
                data, at = data + got[0], got[1]
            if place + 4 > len(data) or place + 4 + struct.unpack_from("<i", data, place)[0] > len(data):
                break
            places.append(place)
            place += 4 + struct.unpack_from("<i", data, place)[0]
        if places:
            yield data, np.array(places)
        if limit is not None and place >= limit:
            return
        if not places and limit is None:
            got = blocks.block(at) if at < stop else None
            if got is None:
                limit = len(data)
            else:
                data, at = data + got[0], got[1]
            continue
        data, place, limit = data[place:], 0, None if limit is None else limit - place


def _tags(raw: np.ndarray, data: bytes, at: np.ndarray, end: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(values, found) of the integer tags of ``TAGS``, read one tag of all records at a time."""
    out = {t: (np.zeros(len(at), np.int64), np.zeros(len(at), bool)) for t in TAGS}
    codes = {t: t.encode()[0] << 8 | t.encode()[1] for t in TAGS}
    at = at.copy()
    rows = np.flatnonzero(at + 3 <= end)
    while len(rows):
        here = at[rows]
        code, kind = raw[here].astype(np.int64) << 8 | raw[here + 1], raw[here + 2]
        width = np.zeros(len(rows), np.int64)
        for letter, size in SIZES.items():
            of = kind == ord(letter)
            if not of.any():
                continue
            width[of] = size
            if letter in "cCsSiI":
                cells = raw[here[of][:, None] + 3 + np.arange(size)].view({"c": "i1", "C": "u1", "s": "<i2", "S": "<u2", "i": "<i4", "I": "<u4"}[letter])[:, 0]
                for t, c in codes.items():
                    hit = code[of] == c
                    if hit.any():
                        values, found = out[t]
                        values[rows[of][hit]], found[rows[of][hit]] = cells[hit], True
        for k in np.flatnonzero(width == 0).tolist():
            value = int(here[k]) + 3
            if chr(kind[k]) in "ZH":
                width[k] = data.index(b"\0", value) + 1 - value
            else:
                width[k] = 5 + SIZES[chr(data[value])] * struct.unpack_from("<i", data, value + 1)[0]
        at[rows] = here + 3 + width
        rows = rows[at[rows] + 3 <= end[rows]]
    return out


def parsed(data: bytes, places: np.ndarray, names: list[str], both: bool, region: tuple[str, int, int] | None = None) -> pa.RecordBatch:
    """Pairs with flag and multi of the records at ``places``; the copies from the second end only with ``both``."""
    raw = np.frombuffer(data, np.uint8)
    fixed = raw[places[:, None] + np.arange(36)].view("<i4")
    ref, pos, packed, ops_flag, n_seq, other, other_pos, other_len = fixed[:, 1:].T
    n_name, n_ops, flag = packed & 255, ops_flag & 0xFFFF, (ops_flag >> 16) & 0xFFFF
    cigar = places + 36 + n_name
    op = np.where(n_ops > 0, _ints(np.r_[raw, np.zeros(4, np.uint8)], cigar), 0)
    keep = np.full(len(places), True) if both else (op & 15) == OPERATIONS.index("P")
    if region is not None:
        chrom, low, high = region
        keep &= (ref == (names.index(chrom) if chrom in names else -2)) & (pos + 1 >= low) & (pos + 1 <= high)
    rows = np.flatnonzero(keep)
    tags = _tags(raw, data, (cigar + 4 * n_ops + (n_seq + 1) // 2 + n_seq)[rows], (places + 4 + fixed[:, 0])[rows])
    read = [data[a:b].decode() for a, b in zip((places[rows] + 36).tolist(), (cigar[rows] - 1).tolist(), strict=True)]
    chroms = pa.array([*names, None], pa.string())
    at = lambda refs: chroms.take(pa.array(np.where(refs < 0, len(names), refs)))
    whole = lambda x, kind=pa.int64(): pa.array(x).cast(kind)
    tag = lambda name, kind=pa.int64(): pa.array(tags[name][0], mask=~tags[name][1]).cast(kind)
    multi = np.where(tags["TC"][1], tags["TC"][0], 1)
    columns = {
        "read_id": pa.array(read, pa.string()),
        **{"c1": at(ref[rows]), "p1": whole(pos[rows] + 1), "s1": tag("S1", pa.int32()), "l1": whole(op[rows] >> 4, pa.int32()), "rs1": tag("E1"), "re1": tag("E2")},
        **{"c2": at(other[rows]), "p2": whole(other_pos[rows] + 1), "s2": tag("S2", pa.int32()), "l2": whole(other_len[rows], pa.int32()), "rs2": tag("E3"), "re2": tag("E4")},
        "flag": whole(flag[rows], pa.int32()),
        "multi": whole(multi, pa.int32()),
    }
    return pa.RecordBatch.from_pydict(columns)


SCHEMA = (
    "read_id string, c1 string, p1 long, s1 int, l1 int, rs1 long, re1 long, "
    "c2 string, p2 long, s2 int, l2 int, rs2 long, re2 long, flag int, multi int"
)


def scan(blocks: Blocks, start: int, stop: int, both: bool = False, region: tuple[str, int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """The pairs of one range of a file."""
    names, _, block, place = references(blocks)
    for data, places in windows(blocks, len(names), (block, place), start, stop):
        for k in range(0, len(places), 20_000):
            batch = parsed(data, places[k : k + 20_000], names, both, region)
            if batch.num_rows:
                yield batch


# ---------------------------------------------------------------- index


class Index:
    """Chunks by bin and least offsets by window of one file, in the BAI format."""

    def __init__(self):
        self.chunks: dict[int, dict[int, list[list[int]]]] = defaultdict(lambda: defaultdict(list))
        self.linear: dict[int, dict[int, int]] = defaultdict(dict)

    def add(self, ref: int, pos: int, start: int, end: int) -> None:
        """One record at position ``pos`` (from 0) between two virtual offsets."""
        window = pos >> LINEAR
        chunks = self.chunks[ref][4681 + window]
        if chunks and chunks[-1][1] == start:
            chunks[-1][1] = end
        else:
            chunks.append([start, end])
        self.linear[ref].setdefault(window, start)

    def encoded(self, n_refs: int) -> bytes:
        out = [b"BAI\1", struct.pack("<i", n_refs)]
        for ref in range(n_refs):
            bins, windows = self.chunks.get(ref, {}), self.linear.get(ref, {})
            out.append(struct.pack("<i", len(bins)))
            for b, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", b, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            n = max(windows, default=-1) + 1
            out.append(struct.pack("<i", n) + np.array([windows.get(w, 0) for w in range(n)], "<u8").tobytes())
        return b"".join(out)


def indexed_range(index: bytes, ref: int, low: int, high: int, size: int) -> tuple[int, int] | None:
    """Compressed bytes [start, stop) of the blocks that can hold records at positions low to high (from 1)."""
    if index[:4] != b"BAI\1":
        raise ValueError("not an index")
    n_refs, at = struct.unpack_from("<i", index, 4)[0], 8
    offsets = []
    for _ in range(n_refs):
        n_bin = struct.unpack_from("<i", index, at)[0]
        at += 4
        for _ in range(n_bin):
            at += 8 + 16 * struct.unpack_from("<i", index, at + 4)[0]
        n = struct.unpack_from("<i", index, at)[0]
        offsets.append(np.frombuffer(index, "<u8", n, at + 4))
        at += 4 + 8 * n
    if not 0 <= ref < n_refs:
        return None
    mine = offsets[ref]
    first, last = max(low - 1, 0) >> LINEAR, max(high - 1, 0) >> LINEAR
    inside = mine[first : last + 1]
    if not inside.any():
        return None
    after = [x[x > 0] for x in (mine[last + 1 :], *offsets[ref + 1 :])]
    stops = [int(x[0]) for x in after if len(x)]
    # Where the next record starts inside a block, that block's head still belongs to the range.
    stop = (stops[0] >> 16) + (1 if stops[0] & 0xFFFF else 0) if stops else size
    return int(inside[inside > 0][0]) >> 16, stop


# ---------------------------------------------------------------- tables


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files of a folder, a pattern or one file; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length").where(~F.col("path").endswith(".bai"))


def _range_batches(split: int, region):
    def run(batches):
        for batch in batches:
            out = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                start, stop = 0, length
                if region is not None:
                    system, name = located(path)
                    if system.get_file_info(name + ".bai").type == fs.FileType.File:
                        with system.open_input_file(name) as f:
                            names = references(Blocks(f, length, 1 << 16))[0]
                        with system.open_input_file(name + ".bai") as f:
                            found = indexed_range(f.read(), names.index(region[0]) if region[0] in names else -1, region[1], region[2], length)
                        if found is None:
                            continue
                        start, stop = found
                out += [(path, length, a, min(a + split, stop)) for a in range(start, stop, split)]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = [pa.string(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "length", "start", "stop"])

    return run


def _scan_batches(both: bool, region):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, name = located(row["path"])
                with system.open_input_file(name) as f:
                    yield from scan(Blocks(f, row["length"]), row["start"], row["stop"], both, region)

    return run


def ranges(spark: SparkSession, path: str, split: int = SPLIT, region: tuple[str, int, int] | None = None) -> DataFrame:
    """(path, length, start, stop): the ranges of bytes that a read of all records, or of a region's, opens."""
    listed = ship(_listed(spark, path)).repartition("path")
    return listed.mapInArrow(_range_batches(split, region), "path string, length long, start long, stop long")


def read_contacts(spark: SparkSession, path: str, both: bool = False, region: tuple[str, int, int] | None = None, split: int = SPLIT) -> DataFrame:
    """Pairs with flag and multi of BAM files of any size.

    ``both`` gives each pair from either end; ``region`` (chromosome, first and last position)
    keeps records whose own end lies in it and reads the blocks that the files' indexes name.
    """
    dealt = ranges(spark, path, split, region).repartition("path", "start")
    return dealt.mapInArrow(_scan_batches(both, region), SCHEMA)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) in the header's order, from the first file."""

    def run(batches):
        for batch in batches:
            for name, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                system, local = located(name)
                with system.open_input_file(local) as f:
                    names, lengths, _, _ = references(Blocks(f, length, 1 << 16))
                yield pa.RecordBatch.from_pydict({"ord": pa.array(range(len(names)), pa.int64()), "chrom": pa.array(names, pa.string()), "length": pa.array(lengths, pa.int64())})

    first = ship(_listed(spark, path)).orderBy("path").limit(1)
    return first.mapInArrow(run, "ord long, chrom string, length long").orderBy("ord").drop("ord")


def _sides(pairs: DataFrame, chroms: list[tuple[str, int]], long: bool) -> DataFrame:
    """Two rows for every pair, one from either end, with chromosomes as places in the header."""
    of = pairs.sparkSession.createDataFrame([(c, k) for k, (c, _) in enumerate(chroms)], "chrom string, ref int")
    flag = (F.col("flag") if "flag" in pairs.columns else F.lit(0)).cast("int").alias("flag")
    multi = (F.col("multi") if "multi" in pairs.columns else F.lit(1)).cast("int").alias("TC")
    for k in (1, 2):
        known = of.select(F.col("chrom").alias(f"c{k}"), F.col("ref").alias(f"ref{k}"))
        pairs = pairs.join(known, f"c{k}", "left")
        missing = F.raise_error(F.concat(F.lit("not in the header: "), F.coalesce(f"c{k}", F.lit("null"))))
        pairs = pairs.withColumn(f"ref{k}", F.coalesce(f"ref{k}", missing.cast("int")))
    side = lambda a, b, kind: F.struct(
        F.col(f"ref{a}").alias("ref"), F.col(f"p{a}").alias("pos"), F.col(f"l{a}").alias("len"), F.lit(kind).alias("kind"),
        F.col(f"ref{b}").alias("other"), F.col(f"p{b}").alias("other_pos"), F.col(f"l{b}").alias("other_len"),
        F.col(f"s{a}").alias("S1"), F.col(f"s{b}").alias("S2"),
        *([F.col(f"{x}{k}").alias(t) for t, (x, k) in zip(TAGS[3:], (("rs", a), ("re", a), ("rs", b), ("re", b)), strict=True)] if long else []),
    )
    each = pairs.select("read_id", flag, multi, F.explode(F.array(side(1, 2, "P"), side(2, 1, "S"))).alias("r"))
    return each.select("read_id", "flag", "TC", "r.*")


def _encoded(batch: pa.RecordBatch, tags: list[str]) -> list[bytes]:
    """The records of a batch; columns are packed as arrays and joined with the names."""
    n = batch.num_rows
    col = lambda name: np.asarray(batch.column(name).cast(pa.int64()))
    reads = [r.encode()[:254] + b"\0" for r in batch.column("read_id").to_pylist()]
    sizes = np.array([len(r) for r in reads], np.int64)
    pos = col("pos") - 1
    values = [(t, np.asarray(batch.column(t).cast(pa.int64()).fill_null(0)), np.asarray(batch.column(t).is_valid())) for t in tags]
    tail = [b""] * n
    if all(v[2].all() for v in values):
        packed = np.zeros((n, 7 * len(tags)), np.uint8)
        for k, (t, value, _) in enumerate(values):
            packed[:, 7 * k : 7 * k + 3] = np.frombuffer(t.encode() + b"i", np.uint8)
            packed[:, 7 * k + 3 : 7 * k + 7] = value.astype("<i4").view(np.uint8).reshape(n, 4)
        tail = [row.tobytes() for row in packed]
    else:
        tail = [b"".join(t.encode() + b"i" + struct.pack("<i", v[k]) for t, v, ok in values if ok[k]) for k in range(n)]
    fixed = np.zeros((n, 9), "<i4")
    fixed[:, 0] = 32 + sizes + 4 + np.array([len(t) for t in tail], np.int64)
    fixed[:, 1], fixed[:, 2] = col("ref"), pos
    fixed[:, 3] = (sizes | (4681 + (pos >> LINEAR)) << 16).astype(np.uint32).view("<i4")
    fixed[:, 4] = (1 | col("flag") << 16).astype(np.uint32).view("<i4")
    fixed[:, 6], fixed[:, 7], fixed[:, 8] = col("other"), col("other_pos") - 1, col("other_len")
    kinds = np.array([OPERATIONS.index(k) for k in batch.column("kind").to_pylist()], np.int64)
    cigar = (col("len") << 4 | kinds).astype("<u4")
    return [b"".join(x) for x in zip(map(np.ndarray.tobytes, fixed), reads, map(np.generic.tobytes, cigar), tail, strict=True)]


def _write_batches(folder: str, head: bytes, n_refs: int, tags: list[str]):
    def run(batches):
        system, base = located(folder)
        part = TaskContext.get().partitionId()
        final, scratch = f"{base}/part-{part:05d}.bam", f"{base}/_{uuid.uuid4().hex}"
        index, out, held, written, rows = Index(), None, [], 0, 0

        def flush():
            nonlocal written
            if held:
                places = np.cumsum([0, *(len(r) for _, _, r in held)])
                block = compressed_block(b"".join(r for _, _, r in held))
                after = (written + len(block)) << 16
                for k, (ref, pos, _) in enumerate(held):
                    end = written << 16 | int(places[k + 1]) if k + 1 < len(held) else after
                    index.add(ref, pos, written << 16 | int(places[k]), end)
                out.write(block)
                written += len(block)
                held.clear()

        def begin():
            nonlocal out, written
            out = system.open_output_stream(scratch)
            for k in range(0, len(head), BLOCK):
                block = compressed_block(head[k : k + BLOCK])
                out.write(block)
                written += len(block)

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                begin()
            records = _encoded(batch, tags)
            for ref, pos, record in zip(batch.column("ref").to_pylist(), batch.column("pos").to_pylist(), records, strict=True):
                if size + len(record) > BLOCK:
                    flush()
                    size = 0
                held.append((ref, pos - 1, record))
                size += len(record)
            rows += len(records)
        if out is None:
            if part:
                return
            begin()
        flush()
        out.write(EOF)
        out.close()
        with system.open_output_stream(scratch + ".bai") as f:
            f.write(index.encoded(n_refs))
        system.move(scratch + ".bai", final + ".bai")
        system.move(scratch, final)
        yield pa.RecordBatch.from_pydict({"file": [final.rsplit("/", 1)[1]], "rows": pa.array([rows], pa.int64()), "bytes": pa.array([written + len(EOF)], pa.int64())})

    return run


def write_contacts(pairs: DataFrame, path: str, chroms: list[tuple[str, int]], head: bytes, long: bool = True, files: int | None = None) -> None:
    """Sorted BAM files of the pairs, an index beside each, and last the list of files in ``_files``.

    ``files`` is the number of ranges; if it is not given, the session's shuffle partitions, or more where
    these would get over ``RECORDS`` records each.
    """
    system, base = located(path)
    system.create_dir(base, recursive=True)
    keys = ["ref", "pos", "read_id", "kind"]
    rows = ship(_sides(pairs, chroms, long))
    if not files:
        needed = -(-2 * pairs.count() // RECORDS)
        files = needed if needed > int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None
    ranged = rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)
    tags = [t for t in TAGS if t in rows.columns]
    made = ranged.sortWithinPartitions(*keys).mapInArrow(_write_batches(path, head, len(chroms), tags), "file string, rows long, bytes long")
    made.write.parquet(f"{path.rstrip('/')}/_files")
