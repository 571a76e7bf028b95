"""Quality classifier: random-indexing vectors, pooled, and a two-layer network.

A word is seen as up to three types: itself in lower case, its shape (letters, digits,
capitals, length), and the symbols at its end; a word that repeats the one before it adds
a fourth.  Every type has a fixed sparse random index vector, which follows from a hash of
its name and is stored nowhere.  A type that stands in at least ``MIN_DOCS`` documents of
a bounded labelled sample also has a context vector, the normalised sum of its
neighbours' index vectors: below that a sum of neighbours is chance.  A type's word vector
is the sum of both.  A document is the mean of its types' vectors, and a network with one
hidden layer, trained with numpy on the driver, gives a probability that is calibrated by
a temperature fitted on rows left out of the training.

The sample has at most ``MAX_ROWS`` labelled rows with at most ``MAX_CHARS`` characters in
all, which bounds the context vectors and so all that is collected or sent to the tasks.
Every word of every text is pooled.

Defined cases: null and empty texts have the zero vector and the network's score for
it; without labels of both classes every score is the share of good labels (0.5 without
any); rows of one labelled id are all fitted, within the bounds, and contradicting labels
of an id count as good; null ids fold like the empty text and are never fitted; extra
columns are carried and replaced where an output column has their name.
"""

from __future__ import annotations

import operator
import string
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import SAMPLE_PARTITIONS, cut, fold, labelled_sample, without
from contactloom.shipping import ship

MAX_ROWS = 8000
MAX_CHARS = 24_000_000
MIN_DOCS = 5
DIM = 64
NONZERO = 6
HIDDEN = 16
THRESHOLD = 0.7
#: Words that a worker remembers with their sums, and the characters that it pools at once.
CACHE = 60_000
SLICE_CHARS = 300_000
_SUMS = [f"s{k}" for k in range(DIM)]
SYMBOLS = string.punctuation + "«»“”„’‘…–—¿¡"
REPEAT = "<repeat>"


def types(word: str) -> tuple[str, str, str]:
    """A word's core in lower case, its core's shape, and the symbols at its end; empty where there is none."""
    core = word.strip(SYMBOLS)
    if core == word:
        symbols = ""
    else:
        symbols = f"<s{(word[len(word.rstrip(SYMBOLS)) :] if core else word)[-3:]}>"
    if not core:
        return "", "", symbols
    kind = "w" if core.isalpha() else "d" if core.isdigit() else "x"
    if len(core) > 1 and core.isupper():
        kind = "U"
    return core.lower(), f"<{kind}{min(len(core), 12) // 4}>", symbols


def index_vectors(names: list[str]) -> np.ndarray:
    """The types' fixed sparse ternary vectors, one row each; zero for the empty name."""
    code = np.fromiter((zlib.crc32(n.encode("utf-8", "replace")) for n in names), dtype=np.uint64, count=len(names))
    named = np.fromiter((n != "" for n in names), dtype=bool, count=len(names))
    out = np.zeros((len(names), DIM), dtype=np.float32)
    rows = np.arange(len(names))
    for k in range(1, NONZERO + 1):
        x = (code + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) * np.uint64(2 * k + 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        sign = ((x >> np.uint64(20)) & np.uint64(1)).astype(np.float32) * 2 - 1
        out[rows, (x >> np.uint64(24)) % np.uint64(DIM)] += sign * named
    return out


def _type_docs(batches):
    """Rows (type, docs) of a task's documents."""
    docs: Counter = Counter()
    known: dict[str, tuple[str, str, str]] = {}
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found = set()
            for w in set((text or "").split()):
                if w not in known:
                    known[w] = types(w)
                found.update(known[w])
            docs.update(found)
    docs.pop("", None)
    yield pa.RecordBatch.from_arrays([pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64())], ["type", "docs"])


class Vectors:
    """Context vectors of the frequent types; pools texts."""

    def __init__(self, names: list[str]):
        self.ids = {t: i for i, t in enumerate(names)}
        self.contexts = np.zeros((len(names) + 1, DIM), dtype=np.float32)  # the last row is that of all others
        self.repeat = index_vectors([REPEAT])[0]
        self._forget()

    def _forget(self) -> None:
        self._rows: dict[str, int] = {}
        self._sums = np.zeros((0, DIM), dtype=np.float32)

    def __getstate__(self):
        return self.__dict__ | {"_rows": {}, "_sums": np.zeros((0, DIM), dtype=np.float32)}

    def of(self, names: list[str]) -> np.ndarray:
        at = np.fromiter((self.ids.get(n, -1) for n in names), dtype=np.int64, count=len(names))
        return index_vectors(names) + self.contexts[at]

    def _learn(self, words: list[list[str]]) -> None:
        """Remember the summed vectors of a slice's words, in a bounded cache."""
        if len(self._rows) > CACHE:
            self._forget()
        rows, new = self._rows, []
        for found in words:
            for w in found:
                if w not in rows:
                    rows[w] = len(rows)
                    new.append(w)
        if new:
            cores, shapes, symbols = zip(*map(types, new), strict=True)
            added = self.of(list(cores))
            for names in (shapes, symbols):  # few different ones
                kinds = sorted(set(names))
                place = {n: i for i, n in enumerate(kinds)}
                added += self.of(kinds)[[place[n] for n in names]]
            self._sums = np.concatenate([self._sums, added])

    def pool(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), DIM))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE_CHARS):
                size += len(texts[end] or "")
                end += 1
            words = [(t or "").split() for t in texts[at:end]]
            self._learn(words)
            row = self._rows.__getitem__
            for i, found in enumerate(words, at):
                if found:
                    total = self._sums[np.fromiter(map(row, found), dtype=np.int64, count=len(found))].sum(axis=0, dtype=np.float64)
                    repeats = sum(map(operator.eq, found, found[1:]))
                    out[i] = (total + repeats * self.repeat) / len(found)
            at = end
        return out


def _contexts(vectors: Vectors):
    """Rows (type id, one sum per dimension): neighbours' index vectors in a window of one word on either side."""

    def run(batches):
        sums = np.zeros((len(vectors.ids), DIM), dtype=np.int64)
        for batch in batches:
            place: dict[str, int] = {}
            seen = []
            for text in batch.column("text").to_pylist():
                words = (text or "").split()
                seen.append(np.fromiter((place.setdefault(w, len(place)) for w in words), dtype=np.int64, count=len(words)))
                seen.append(np.array([-1]))
            if not place:
                continue
            ids = np.concatenate(seen)
            cores = [types(w)[0] for w in place]
            known = np.fromiter((vectors.ids.get(c, -1) for c in cores), dtype=np.int64, count=len(cores))
            index = index_vectors(cores).astype(np.int8)
            a, b = ids[:-1], ids[1:]
            ok = (a >= 0) & (b >= 0)
            pairs, n = np.unique(np.r_[a[ok] * len(place) + b[ok], b[ok] * len(place) + a[ok]], return_counts=True)
            left, right = known[pairs // len(place)], pairs % len(place)
            for at in range(0, len(pairs), 10_000):
                part = slice(at, at + 10_000)
                own = left[part] >= 0
                np.add.at(sums, left[part][own], index[right[part][own]] * n[part][own, None])
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        columns = [pa.array(used), *[pa.array(sums[used, k]) for k in range(DIM)]]
        yield pa.RecordBatch.from_arrays(columns, ["id", *_SUMS])

    return run


class Network:
    """tanh layer and logistic output with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, steps: int = 200, rate: float = 0.03):
        rng = np.random.default_rng(7)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.05
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), (1,)]
        w = [rng.normal(0, 0.2, s) if len(s) > 1 or s == (HIDDEN,) else np.zeros(s) for s in shapes]
        w[1][:] = 0
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        z, t = (x[~held] - self.mean) / self.scale, y[~held]
        for step in range(1, steps + 1):
            h = np.tanh(z @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
            d = (p - t) / len(t)
            dh = np.outer(d, w[2]) * (1 - h * h)
            grads = [z.T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        if held.any():
            logits, truth = self.logits(x[held]), y[held]
            loss = lambda k: np.logaddexp(0, np.where(truth > 0, -logits, logits) / k).mean()
            self.temperature = min(np.geomspace(0.5, 8, 60), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh((x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


class Model:
    def __init__(self, vectors: Vectors, network: Network | None, share: float):
        self.vectors, self.network, self.share = vectors, network, share

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network.probability(self.vectors.pool(texts))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    sample = labelled_sample(ship(docs), labels, "quality", fold(F.col("doc_id"), 4) != 2, limit, max_chars)
    sample = cut(sample.repartition(SAMPLE_PARTITIONS, "doc_id"))
    counted = sample.mapInArrow(_type_docs, "type string, docs long").groupBy("type").agg(F.sum("docs").alias("docs"))
    names = counted.where(F.col("docs") >= MIN_DOCS).toArrow()["type"].to_pylist()
    vectors = Vectors(sorted(names))
    added = (
        sample.mapInArrow(_contexts(vectors), "id long, " + ", ".join(f"{c} long" for c in _SUMS))
        .groupBy("id")
        .agg(*[F.sum(c).alias(c) for c in _SUMS])
        .toArrow()
    )
    if added.num_rows:
        total = np.stack([added[c].to_numpy() for c in _SUMS], axis=1).astype(float)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        vectors.contexts[added["id"].to_numpy()] = 0.5 * np.sqrt(NONZERO) * total / np.maximum(norm, 1e-9)

    @F.pandas_udf("array<double>")
    def pooled(text: pd.Series) -> pd.Series:
        return pd.Series(list(vectors.pool(text.tolist())))

    rows = sample.select(F.xxhash64("doc_id").alias("h"), "doc_id", "label", pooled("text").alias("x")).collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["x"]))
    y = np.array([r["label"] for r in rows], dtype=float)
    if len(set(y)) < 2:
        return Model(vectors, None, float(y.mean()) if len(y) else 0.5)
    x = np.array([r["x"] for r in rows])
    return Model(vectors, Network(x, y, np.arange(len(y)) % 5 == 0), float(y.mean()))


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with held_out, score and predicted.  The model goes to the tasks as a broadcast of bounded size."""
    shared = ship(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text.tolist()))

    return docs.select(
        *without(docs, {"held_out", "score", "predicted"}),
        (fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    names = [f"c{i}" if c not in ("doc_id", "text") else c for i, c in enumerate(docs.columns)]
    judged = judge(docs.toDF(*names), fit(docs.select("doc_id", "text"), labels)).where("predicted = 1")
    return judged.select(*[F.col(a).alias(c) for a, c in zip(names, docs.columns, strict=True)])


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")
