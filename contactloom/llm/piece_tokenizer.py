"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct units (a word with the blanks before it) are concatenated and
their suffixes sorted up to the longest piece.  Every piece of the vocabulary is
binary-searched, one character at a time, for its range of occurrences; the ranges
become edges (start, end, piece), which are sorted by end position and relaxed from
left to right.

The vocabulary is a BPE one, whose encoding is not the best-scoring path.  The
relaxation therefore accepts an edge only if it is *compatible* with the piece that
ends where it starts, that is, if the two pieces' joined text encodes to just these
two.  A sequence is the BPE encoding of its text exactly if all neighbours are
compatible, so one edge survives at every position and the result equals that of
the merge procedure.  Characters outside the vocabulary become byte pieces.

Pieces have blanks only at their start and never hold a line feed, so units are
encoded independently; results of short ones are kept in a cache of bounded bytes.  A
unit without blanks takes one round per character, whatever its length.

Defined cases: null and empty texts have no pieces and decode to the empty text;
texts of any length are encoded whole; U+2581 decodes to a blank, as the format
defines; rows that repeat are encoded alike; extra columns are carried and replaced
where an output column has their name.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from contactloom.llm.common import without
from contactloom.shipping import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
UNITS = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")
#: Characters of units that are indexed at once; units that a worker remembers, and the longest of them.
CHUNK = 200_000
CACHE = 150_000
CACHED_LENGTH = 60
PAIRS = 2_000_000
#: Text that is encoded before a batch is handed back.
BATCH_CHARS = 2_000_000


class Vocabulary:
    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes_at = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.out = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i)
            else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(BLANK, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        known = sorted(self.ids)
        self.order = np.array([self.ids[p] for p in known], dtype=np.int64)
        self.lengths = np.array([len(p) for p in known], dtype=np.int64)
        self.longest = int(self.lengths.max())
        chars = np.zeros((len(known), self.longest), dtype=np.uint32)
        for row, p in zip(chars, known, strict=True):
            row[: len(p)] = np.frombuffer(p.encode("utf-32-le"), dtype=np.uint32)
        self.chars = chars
        #: judged pairs of pieces, sorted, and whether they are compatible
        self._keys, self._known = np.array([-1]), np.zeros(1, dtype=bool)
        self.cache: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """The merge procedure on a short text: best score first, leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether pieces follow each other in an encoding; before: -1 at a unit's start, -2 after a foreign character."""
        n = len(self.pieces)
        keys, back = np.unique((np.maximum(before, -1) + 1) * n + piece, return_inverse=True)
        at = np.searchsorted(self._keys, keys)
        at[at == len(self._keys)] = 0
        new = self._keys[at] != keys
        if new.any():
            added = keys[new]
            found = np.fromiter(map(self._compatible, added.tolist()), dtype=bool, count=len(added))
            if len(self._keys) > PAIRS:
                self._keys, self._known = np.array([-1]), np.zeros(1, dtype=bool)
            every = np.r_[self._keys, added]
            order = np.argsort(every, kind="stable")
            self._keys, self._known = every[order], np.r_[self._known, found][order]
            at = np.searchsorted(self._keys, keys)
            if (self._keys[np.minimum(at, len(self._keys) - 1)] != keys).any():  # the table was emptied
                return np.fromiter(map(self._compatible, keys.tolist()), dtype=bool, count=len(keys))[back]
        return self._known[at][back]

    def _compatible(self, key: int) -> bool:
        left, right = divmod(key, len(self.pieces))
        p = self.pieces[right]
        return self.merge(p) == [p] if left == 0 else self.merge(self.pieces[left - 1] + p) == [self.pieces[left - 1], p]

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of every occurrence of every piece in ``text``."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
        step = 1
        while True:
            key = rank * (n + 2)
            key[: n - step] += rank[step:] if step < n else 0
            suffixes = np.argsort(key)
            ordered = key[suffixes]
            rank = np.empty(n, dtype=np.int64)
            rank[suffixes] = np.cumsum(np.r_[1, ordered[1:] != ordered[:-1]])
            step *= 2
            if step >= self.longest or step >= n:
                break
        padded = np.r_[text, np.zeros(self.longest + 1, dtype=np.uint32)]
        live = np.arange(len(self.order))
        lo, hi = np.zeros(len(live), dtype=np.int64), np.full(len(live), n, dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for depth in range(self.longest):
            want = self.chars[live, depth]

            def bound(low, high, upper, want=want, depth=depth):
                low, high = low.copy(), high.copy()
                while (open_ := low < high).any():
                    mid = (low + high) >> 1
                    seen = padded[suffixes[np.minimum(mid, n - 1)] + depth]
                    right = open_ & ((seen <= want) if upper else (seen < want))
                    low = np.where(right, mid + 1, low)
                    high = np.where(open_ & ~right, mid, high)
                return low

            lo, hi = bound(lo, hi, False), bound(lo, hi, True)
            ends = (self.lengths[live] == depth + 1) & (lo < hi)
            done.append((live[ends], lo[ends], hi[ends]))
            go = (self.lengths[live] > depth + 1) & (lo < hi)
            live, lo, hi = live[go], lo[go], hi[go]
            if not len(live):
                break
        which, lo, hi = (np.concatenate(x) for x in zip(*done, strict=True))
        counts = hi - lo
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = suffixes[np.repeat(lo, counts) + inside]
        return start, start + np.repeat(self.lengths[which], counts), np.repeat(self.order[which], counts)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Ids of each unit as packed int32."""
        text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([len(u) for u in units])
        starts = np.r_[0, ends[:-1]]
        unit_of = np.repeat(np.arange(len(units)), ends - starts)
        start, end, piece = self.occurrences(text)
        inside = end <= ends[unit_of[start]]
        start, end, piece = start[inside], end[inside], piece[inside]
        single = np.zeros(len(text), dtype=bool)
        single[start[end - start == 1]] = True
        foreign = np.flatnonzero(~single)
        start, end = np.r_[start, foreign], np.r_[end, foreign + 1]
        piece = np.r_[piece, np.full(len(foreign), -2)]
        offset = end - starts[unit_of[start]]
        narrow = offset.astype(np.uint16) if offset.max(initial=0) < 65536 else offset
        order = np.argsort(narrow, kind="stable")
        start, end, piece, offset = start[order], end[order], piece[order], offset[order]
        last = np.full(len(text) + 1, -3, dtype=np.int64)
        back = np.zeros(len(text) + 1, dtype=np.int64)
        first = np.zeros(len(text) + 1, dtype=bool)
        first[starts] = True
        limits = np.r_[0, np.flatnonzero(np.diff(offset)) + 1, len(offset)]
        for a, b in zip(limits[:-1], limits[1:], strict=True):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            before = np.where(first[s], -1, last[s])
            ok = (p == -2) | (before == -2)
            alone = np.flatnonzero((p >= 0) & (before == -2))
            ok[alone] = self.compatible(np.full(len(alone), -1), p[alone])
            ask = np.flatnonzero((p >= 0) & (before != -2))
            ok[ask] = self.compatible(before[ask], p[ask])
            last[e[ok]], back[e[ok]] = p[ok], s[ok]
        return self._paths(text, last, back, starts, ends)

    def _paths(self, text, last, back, starts, ends) -> list[bytes]:
        """Packed ids of every unit: all units are walked back at once, one piece a step."""
        unit, at = np.arange(len(starts)), np.asarray(ends, dtype=np.int64)
        units, pieces, places = [], [], []
        while len(unit):
            units.append(unit)
            pieces.append(last[at])
            at = back[at]
            places.append(at)
            more = at > starts[unit]
            unit, at = unit[more], at[more]
        steps = np.repeat(np.arange(len(units)), [len(u) for u in units])
        unit, piece, place = np.concatenate(units), np.concatenate(pieces), np.concatenate(places)
        order = np.lexsort((-steps, unit))
        unit, piece, place = unit[order], piece[order], place[order]
        foreign = np.flatnonzero(piece < 0)
        if len(foreign):
            spelled = [[self.bytes_at[b] for b in chr(c).encode("utf-8", "replace")] for c in text[place[foreign]].tolist()]
            count = np.ones(len(piece), dtype=np.int64)
            count[foreign] = [len(x) for x in spelled]
            unit, piece = np.repeat(unit, count), np.repeat(piece, count)
            piece[piece < 0] = np.concatenate(spelled)
        cuts = 4 * np.r_[0, np.cumsum(np.bincount(unit, minlength=len(starts)))]
        packed, cuts = piece.astype(np.int32).tobytes(), cuts.tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [UNITS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = sorted({u for units in cut for u in units if u not in cache}, key=len)
        i = 0
        while i < len(new):
            j, size = i, 0
            while j < len(new) and (j == i or size + len(new[j]) <= CHUNK):
                size += len(new[j])
                j += 1
            cache.update(zip(new[i:j], self.encode_units(new[i:j]), strict=True))
            i = j
        ids = [np.frombuffer(b"".join([cache[u] for u in units]), dtype=np.int32) for units in cut]
        for u in new:  # long units are not worth their bytes
            if len(u) > CACHED_LENGTH:
                del cache[u]
        return ids

    def decode(self, ids) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    return Vocabulary(model)


def _pieces_of(texts: list[str]):
    """Slices of a batch with a bounded amount of text."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BATCH_CHARS):
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def _mapped(df: DataFrame, outputs: list[T.StructField], compute) -> DataFrame:
    """``df`` with output columns that ``compute(batch)`` yields for slices of a batch; other columns are carried."""
    kept = df.select(*without(df, [f.name for f in outputs]))
    return ship(kept).mapInArrow(compute, T.StructType([*kept.schema.fields, *outputs]))


def _runner(model: bytes, text_col: str, ids_col: str, mode: str, names: list[str]):
    def run(batches):
        vocab = vocabulary(model)
        for batch in batches:
            column = batch.column(ids_col if mode == "decode" else text_col)
            if mode == "decode":
                values = column.to_pylist()
                decoded = pa.array([vocab.decode(v or []) for v in values], pa.string())
                rest = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*rest, decoded], [*names, text_col])
                continue
            texts = [t or "" for t in column.to_pylist()]
            for at, part in _pieces_of(texts):
                ids = vocab.encode(part)
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                arrays = [batch.column(c).slice(at, len(part)) for c in names]
                made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                counts = pa.array(np.diff(offsets).astype(np.int64))
                arrays += [made, counts]
                labels = [*names, ids_col, "n_tokens"]
                if mode == "both":
                    decoded = [vocab.decode(x.tolist()) for x in ids]
                    same = [d == t.replace(BLANK, " ") for d, t in zip(decoded, part, strict=True)]
                    arrays += [pa.array([len(d) for d in decoded], pa.int64()), pa.array(same)]
                    labels += ["decoded_chars", "round_trip"]
                yield pa.RecordBatch.from_arrays(arrays, labels)

    return run


def _apply(df: DataFrame, mode: str, model_file: str, text_col: str, ids_col: str) -> DataFrame:
    with open(model_file, "rb") as f:
        model = f.read()
    ids = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]
    checks = [T.StructField("decoded_chars", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    outputs = {"encode": ids, "both": ids + checks, "decode": [T.StructField(text_col, T.StringType())]}[mode]
    gone = {f.name.lower() for f in outputs}
    names = [c for c in df.columns if c.lower() not in gone]
    return _mapped(df, outputs, _runner(model, text_col, ids_col, mode, names))


def encode(docs: DataFrame, model_file: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of the whole text and their number."""
    return _apply(docs, "encode", model_file, text_col, ids_col)


def decode(df: DataFrame, model_file: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the text that its ids stand for."""
    return _apply(df, "decode", model_file, text_col, ids_col)


def encode_and_check(docs: DataFrame, model_file: str = MODEL) -> DataFrame:
    """``encode`` with the ids decoded again: ``decoded_chars`` and whether the text came back."""
    return _apply(docs, "both", model_file, "text", "ids")


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_and_check(docs).select("doc_id", "ids", "n_tokens", "decoded_chars", "round_trip")
