"""Contacts as BAM: two records a pair, so that region tools find a contact from either end.

A record has the read's name, the filter flag, the chromosome and position of one end,
mapping quality 0, one pseudo CIGAR operation with the end's length (``P`` in the copy that
starts with the first end, ``S`` in the other), the other end's chromosome and position, the other end's length as the
template length, no sequence, and the tags TC (contacts of the sequenced fragment), S1 and
S2 (strands) and, in long form, E1 to E4 (cut sites around both ends).

``encoded`` gives complete files as rows; ``write_contacts`` writes sorted and indexed files, and
``read_contacts`` reads files of any size in ranges of bytes.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.operators.pairs import FILTERS
from contactloom.shipping import ship
from contactloom.sources import bam_blocks
from contactloom.sources.reads import PAIRS

#: Contacts of one file.
MAX_PAIRS = 500_000
# Fixed values of the format: the end-of-file block, the operations of a CIGAR.
_EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_OPERATIONS = "MIDNSHP=X"
_BLOCK = 0xFF00


def _compressed(data: bytes) -> bytes:
    """``data`` in blocks of the blocked gzip format."""
    out = []
    for at in range(0, len(data), _BLOCK):
        part = data[at : at + _BLOCK]
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
        out.append(head + body + struct.pack("<II", zlib.crc32(part), len(part)))
    return b"".join(out) + _EOF


def _bin(start: int, end: int) -> int:
    """The smallest bin of the five-level index scheme that holds [start, end)."""
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == (end - 1) >> shift:
            return offset + (start >> shift)
    return 0


def header(chroms: list[tuple[str, int]], order: str = "unknown") -> bytes:
    """The file's header for chromosomes (name, length), with the filters' flags."""
    lines = [f"@HD\tVN:1.5\tSO:{order}", *(f"@SQ\tSN:{c}\tLN:{n}" for c, n in chroms)]
    lines += [f"@CO\tfilter:{name.replace(' ', '-')}\tflag:{1 << (k - 1)}" for k, name in FILTERS.items()]
    text = ("\n".join(lines) + "\n").encode()
    refs = b"".join(struct.pack("<i", len(c.encode()) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in chroms)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(chroms)) + refs


def _record(name: str, flag: int, ref: int, pos: int, length: int, kind: str, other: int, other_pos: int, other_len: int, tags: dict[str, int]) -> bytes:
    read = name.encode()[:254] + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(read), 0, _bin(pos - 1, pos), 1, flag, 0, other, other_pos - 1, other_len)
    body += read + struct.pack("<I", length << 4 | _OPERATIONS.index(kind))
    body += b"".join(t.encode() + b"i" + struct.pack("<i", v) for t, v in tags.items())
    return struct.pack("<i", len(body)) + body


def encoded(pairs: DataFrame, chroms: list[tuple[str, int]], long: bool = True) -> DataFrame:
    """(part, content): complete BAM files of the pairs; ``flag`` and ``multi`` are read where the pairs have them."""
    at = {c: k for k, (c, _) in enumerate(chroms)}
    head = header(chroms)
    rows = pairs.select(
        *PAIRS.fieldNames(),
        (F.col("flag") if "flag" in pairs.columns else F.lit(0)).cast("int").alias("flag"),
        (F.col("multi") if "multi" in pairs.columns else F.lit(1)).cast("int").alias("multi"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        for pdf in batches:
            for r in pdf.itertuples():
                sites = [{"E1": r.rs1, "E2": r.re1, "E3": r.rs2, "E4": r.re2}, {"E1": r.rs2, "E2": r.re2, "E3": r.rs1, "E4": r.re1}] if long else [{}, {}]
                one, two = (at[r.c1], r.p1, r.l1), (at[r.c2], r.p2, r.l2)
                held.append(
                    _record(r.read_id, r.flag, *one, "P", *two, {"TC": r.multi, "S1": r.s1, "S2": r.s2} | sites[0])
                    + _record(r.read_id, r.flag, *two, "S", *one, {"TC": r.multi, "S1": r.s2, "S2": r.s1} | sites[1])
                )
                if len(held) >= MAX_PAIRS:
                    yield pd.DataFrame({"content": [_compressed(head + b"".join(held))]})
                    held = []
        if held:
            yield pd.DataFrame({"content": [_compressed(head + b"".join(held))]})

    return ship(rows).mapInPandas(run, "content binary").select(F.monotonically_increasing_id().alias("part"), "content")


def _decoded(content: bytes) -> Iterator[tuple]:
    """Records of one file: (name, flag, chrom, pos, length, kind, other chrom, other pos, other length, tags)."""
    data = gzip.decompress(content)
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    count = struct.unpack_from("<i", data, at)[0]
    at += 4
    names = []
    for _ in range(count):
        size = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    while at < len(data):
        size, ref, pos, n_name, _, _, n_ops, flag, n_seq, other, other_pos, other_len = struct.unpack_from("<iiiBBHHHiiii", data, at)
        here, end = at + 36, at + 4 + size
        name = data[here : here + n_name - 1].decode()
        here += n_name
        ops = struct.unpack_from(f"<{n_ops}I", data, here)
        here += 4 * n_ops + (n_seq + 1) // 2 + n_seq
        tags = {}
        while here < end:
            tag, kind = data[here : here + 2].decode(), chr(data[here + 2])
            here += 3
            if kind in "cCsSiIf":
                form = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}[kind]
                tags[tag] = struct.unpack_from("<" + form, data, here)[0]
                here += struct.calcsize(form)
            elif kind == "A":
                here += 1
            elif kind in "ZH":
                here = data.index(b"\0", here) + 1
            else:  # an array
                form = {"c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}[chr(data[here])]
                here += 5 + form * struct.unpack_from("<i", data, here + 1)[0]
        op = ops[0] if ops else 0
        yield name, flag, names[ref] if ref >= 0 else None, pos + 1, op >> 4, _OPERATIONS[op & 15], names[other] if other >= 0 else None, other_pos + 1, other_len, tags
        at = end


def decoded(files: DataFrame, both: bool = False) -> DataFrame:
    """Pairs with flag and multi of BAM files in a column ``content``; with ``both`` each pair from either end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for name, flag, chrom, pos, length, kind, other, other_pos, other_len, t in _decoded(content):
                    if kind == "P" or both:
                        first = (chrom, pos, t.get("S1"), length, t.get("E1"), t.get("E2"))
                        rows.append((name, *first, other, other_pos, t.get("S2"), other_len, t.get("E3"), t.get("E4"), flag, t.get("TC", 1)))
                    if len(rows) >= 50_000:
                        yield pd.DataFrame(rows, columns=[*PAIRS.fieldNames(), "flag", "multi"])
                        rows = []
                yield pd.DataFrame(rows, columns=[*PAIRS.fieldNames(), "flag", "multi"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAIRS)
    return ship(files.select("content")).mapInPandas(run, f"{schema}, flag int, multi int")


def read_contacts(spark: SparkSession, path: str, both: bool = False, region: tuple[str, int, int] | None = None, split: int = bam_blocks.SPLIT) -> DataFrame:
    """Pairs of BAM files of any size, or of a region by their indexes (see ``bam_blocks``)."""
    return bam_blocks.read_contacts(spark, path, both, region, split)


def read_references(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) in the header's order, from the first file."""
    return bam_blocks.read_references(spark, path)


def write_contacts(pairs: DataFrame, path: str, chroms: list[tuple[str, int]], long: bool = True, files: int | None = None) -> None:
    """Coordinate-sorted BAM files of the pairs with an index beside each (see ``bam_blocks``)."""
    bam_blocks.write_contacts(pairs, path, chroms, header(chroms, "coordinate"), long, files)
