"""BAM files in ranges of bytes, sorted and indexed."""

import io
import os
import random
import struct

import numpy as np
import pytest

from contactloom.sources import bam_blocks, contact_bam
from contactloom.sources.reads import PAIRS

CHROMS = [("a", 900_000), ("b", 40_000_000)]
FIELDS = [*PAIRS.fieldNames(), "flag", "multi"]


def pairs(n=6000, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        c1, c2 = rng.choice("ab"), rng.choice("abb")
        p1, p2 = (rng.randrange(1, 850_000 if c == "a" else 39_000_000) for c in (c1, c2))
        rows.append((f"read.{k}" + "x" * rng.randrange(9), c1, p1, k % 2, 50, p1 - 1, p1 + 300, c2, p2, 1, 60, p2 - 2, p2 + 200, k % 16, 1 + k % 3))
    return rows


SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PAIRS) + ", flag int, multi int"


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bam") / "map")
    rows = pairs()
    contact_bam.write_contacts(spark.createDataFrame(rows, SCHEMA), folder, CHROMS, files=3)
    return folder, rows


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    """One unsorted file whose records run over its blocks."""
    folder = tmp_path_factory.mktemp("one")
    rows = pairs(9000, 2)
    made = contact_bam.encoded(spark.createDataFrame(rows, SCHEMA).coalesce(1), CHROMS).collect()
    assert len(made) == 1
    (folder / "whole.bam").write_bytes(made[0].content)
    return str(folder), rows


def found(df):
    return sorted(tuple(r) for r in df.select(*FIELDS).collect())


@pytest.mark.parametrize("split", [7_000, 65_536, 100_003, 1 << 26])
def test_any_split_gives_the_same_pairs(spark, one_file, split):
    folder, rows = one_file
    ranges = bam_blocks.ranges(spark, folder, split).count()
    assert ranges == -(-os.path.getsize(f"{folder}/whole.bam") // split)
    assert found(contact_bam.read_contacts(spark, folder, split=split)) == sorted(rows)
    assert contact_bam.read_contacts(spark, folder, both=True, split=split).count() == 2 * len(rows)


def test_written_files_are_sorted_and_complete(spark, written):
    folder, rows = written
    assert found(contact_bam.read_contacts(spark, folder, split=30_000)) == sorted(rows)
    names = sorted(f for f in os.listdir(folder) if f.endswith(".bam"))
    assert len(names) == 3 and all(os.path.exists(f"{folder}/{n}.bai") for n in names)
    assert not [f for f in os.listdir(folder) if f.startswith("_") and f != "_files"]
    places = []
    for n in names:
        size = os.path.getsize(f"{folder}/{n}")
        with open(f"{folder}/{n}", "rb") as f:
            for batch in bam_blocks.scan(bam_blocks.Blocks(f, size), 0, size, both=True):
                places += zip(batch.column("c1").to_pylist(), batch.column("p1").to_pylist(), strict=True)
    assert places == sorted(places) and len(places) == 2 * len(rows)
    files = spark.read.parquet(f"{folder}/_files").collect()
    assert sum(r.rows for r in files) == 2 * len(rows) and sum(r.bytes for r in files) == sum(os.path.getsize(f"{folder}/{n}") for n in names)
    assert [tuple(r) for r in contact_bam.read_references(spark, folder).collect()] == CHROMS


@pytest.mark.parametrize("region", [("b", 5_000_000, 5_400_000), ("a", 1, 20_000), ("b", 38_000_000, 40_000_000), ("a", 895_000, 900_000), ("none", 1, 10)])
def test_a_region_reads_its_blocks_only(spark, written, region):
    folder, rows = written
    chrom, low, high = region
    want = [r for r in rows if r[1] == chrom and low <= r[2] <= high]
    swapped = [(r[0], *r[7:13], *r[1:7], *r[13:]) for r in rows if r[7] == chrom and low <= r[8] <= high]
    assert found(contact_bam.read_contacts(spark, folder, region=region)) == sorted(want)
    assert found(contact_bam.read_contacts(spark, folder, both=True, region=region)) == sorted(want + swapped)
    opened = sum(r.stop - r.start for r in bam_blocks.ranges(spark, folder, region=region).collect())
    whole = sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".bam"))
    assert opened < whole / 2


def test_files_without_an_index_are_read_whole_for_a_region(spark, one_file):
    folder, rows = one_file
    assert found(contact_bam.read_contacts(spark, folder, region=("a", 1, 100_000))) == sorted(r for r in rows if r[1] == "a" and r[2] <= 100_000)


def test_empty_and_short_maps(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    contact_bam.write_contacts(empty, str(tmp_path / "none"), CHROMS)
    assert contact_bam.read_contacts(spark, str(tmp_path / "none")).count() == 0
    plain = spark.createDataFrame([r[:13] for r in pairs(50)], PAIRS)
    contact_bam.write_contacts(plain, str(tmp_path / "short"), CHROMS, long=False)
    back = contact_bam.read_contacts(spark, str(tmp_path / "short"))
    assert back.where("rs1 IS NULL AND re2 IS NULL AND flag = 0 AND multi = 1").count() == 50
    with pytest.raises(Exception, match="not in the header"):
        contact_bam.write_contacts(plain, str(tmp_path / "wrong"), [("a", 9)])


def test_foreign_tags_and_sequences_are_passed_over():
    head = contact_bam.header(CHROMS)
    tags = b"XZZtext with \x42 inside\0XBBs\x02\0\0\0\x01\0\x02\0XAAqTCC\x07S1s\xff\xffXff\0\0\x80?S2i\x01\0\0\0"
    out = []
    for k in range(3):
        name, seq = b"r%d\0" % k, 5
        body = struct.pack("<iiBBHHHiiii", 1, 10 + k, len(name), 9, 4681, 2, 5, seq, 0, 99, 33) + name + struct.pack("<II", 40 << 4 | 6, 3 << 4) + bytes(3) + b"\xff" * 5 + tags
        out.append(struct.pack("<i", len(body)) + body)
    data = contact_bam._compressed(head + b"".join(out))
    rows = [r for b in bam_blocks.scan(bam_blocks.Blocks(io.BytesIO(data), len(data)), 0, len(data)) for r in b.to_pylist()]
    assert [(r["read_id"], r["c1"], r["p1"], r["l1"], r["c2"], r["p2"], r["l2"], r["s1"], r["s2"], r["multi"], r["flag"], r["rs1"]) for r in rows] == [
        (f"r{k}", "b", 11 + k, 40, "a", 100, 33, -1, 1, 7, 5, None) for k in range(3)
    ]


def test_damage_and_chance_headers_are_noticed():
    data = bam_blocks.compressed_block(b"some bytes" * 50)
    assert bam_blocks.inflated(data) == b"some bytes" * 50
    with pytest.raises(ValueError):
        bam_blocks.inflated(data[:-5] + b"\0" + data[-4:])
    noise = bam_blocks._MAGIC + bytes(40) + data + data
    blocks = bam_blocks.Blocks(io.BytesIO(noise), len(noise))
    assert blocks.find(0) == 44 and blocks.find(45) == 44 + len(data) and blocks.find(len(noise) - 3) is None


def test_index_names_no_block_for_an_empty_window():
    index = bam_blocks.Index()
    for pos, start, end in ((5, 100 << 16, 100 << 16 | 50), (40_000, 200 << 16 | 7, 300 << 16), (90_000, 300 << 16, 310 << 16)):
        index.add(1, pos, start, end)
    data = index.encoded(3)
    assert bam_blocks.indexed_range(data, 1, 1, 10_000, 999) == (100, 201)
    assert bam_blocks.indexed_range(data, 1, 33_000, 48_000, 999) == (200, 300)
    assert bam_blocks.indexed_range(data, 1, 17_000, 20_000, 999) is None
    assert bam_blocks.indexed_range(data, 1, 81_920, 10**9, 999) == (300, 999)
    assert bam_blocks.indexed_range(data, 0, 1, 10**9, 999) is None and bam_blocks.indexed_range(data, 7, 1, 5, 999) is None
    assert np.frombuffer(data[:4], "S4")[0] == b"BAI\1"
