"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary labelled documents, spell words.
A character's context is the word before it, up to ``ORDER`` - 1 characters from the
word's start mark on.  Each class's counts of a context are discounted absolutely by
``DISCOUNT``, and the freed mass goes to one backoff model that both classes share: the
pooled counts of the same context, and below them Kneser-Ney continuation counts (how
many different characters a string follows) of up to ``LOW`` characters.  An expression
that is rare in a class so costs both models alike.

A toxic text is ordinary text with a few toxic expressions.  Its word probability is
therefore the mixture (1 - ``SHARE``) ordinary + ``SHARE`` toxic, and the score compares
the log-likelihoods of the two models, each divided by the number of words:
the mean over the text's words of log(1 + SHARE (toxic / ordinary - 1)).  Repeats of a
word in a text say nothing new, so documents count words once, in fitting as in scoring.
One slope and one offset turn that difference into a probability; they are fitted on a
quarter of the rows by a model of the others.

Fitted are at most ``MAX_ROWS`` labelled rows with at most ``MAX_CHARS`` characters in
all, which bounds what is counted, collected and sent to the tasks (12 bytes for every
different n-gram of the sample; all of them are kept).  Every text is scored whole.

Defined cases: null and empty texts, and texts without words, have no evidence (a
difference of 0); without labels of both classes every score is the share of toxic
labels (0.1 without any); rows of one labelled id are all fitted, within the bounds, and
contradicting labels of an id count as toxic; null ids fold like the empty text and are
never fitted; extra columns are carried and replaced where an output column has their
name.
"""

from __future__ import annotations

import re
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
ORDER = 12
LOW = 5
DISCOUNT = 2.0
LOW_DISCOUNT = 0.75
SHARE = 0.003
#: Words that a worker remembers, and the longest of them; characters that it scores at once.
CACHE = 200_000
CACHED_LENGTH = 40
SLICE_CHARS = 1_000_000
WORDS = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_START, _END = 1, 2


def tokens(text: str | None) -> set[str]:
    """The different words of a text in lower case."""
    return set(WORDS.findall((text or "").lower()))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) + _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spelled:
    """The characters of words, each with 64-bit hashes of the strings that end with it."""

    def __init__(self, words: list[str]):
        sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        chars = np.zeros(int(sizes.sum()), dtype=np.uint64)
        word_of = np.repeat(np.arange(len(words)), sizes)
        inside = np.ones(len(chars), dtype=bool)
        inside[first] = inside[first + sizes - 1] = False
        chars[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        chars[first], chars[first + sizes - 1] = _START, _END
        # A string's hash is the sum of its characters times powers of an odd base, divided by the power of its start.
        powers = np.multiply.accumulate(np.full(len(chars) + 1, _BASE))
        inverse = np.multiply.accumulate(np.full(len(chars) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64))))
        self._sums = np.r_[np.uint64(0), np.cumsum(_mixed(chars) * powers[:-1])]
        self._inverse = inverse
        ends = np.flatnonzero(np.arange(len(chars)) != first[word_of])  # all but the start marks
        self.word, self.end = word_of[ends], ends + 1
        self.start = np.maximum(first[self.word], self.end - ORDER)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self._sums[end] - self._sums[start]) * self._inverse[start])

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n-gram, hash of its context) of every character."""
        return self.hashes(self.start, self.end), self.hashes(self.start, self.end - 1)


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(different keys, place of every key among them, sums of the values)."""
    found, back = np.unique(keys, return_inverse=True)
    return found, back, [np.bincount(back, weights=v, minlength=len(found)) for v in values]


def _chunks(words: list[str], size: int = 20_000):
    """The words spelled in parts, so that what is built on the way stays small."""
    for at in range(0, len(words), size):
        yield slice(at, at + size), Spelled(words[at : at + size])


def backoff(words: list[str], grams: np.ndarray) -> np.ndarray:
    """Continuation probability of the last character of each n-gram after up to ``LOW`` - 1 characters."""
    p = np.full(len(grams), 1.0 / 256)
    for size in range(1, LOW + 1):
        before, string, context = (np.zeros(len(grams), dtype=np.uint64) for _ in range(3))
        long = np.zeros(len(grams), dtype=bool)  # something stands before the string
        for _, spelled in _chunks(words):
            some = np.flatnonzero(spelled.end - spelled.start > size)
            at = np.searchsorted(grams, spelled.hashes(spelled.start[some], spelled.end[some]))
            e = spelled.end[some]
            before[at], string[at], context[at] = (spelled.hashes(e - a, e - b) for a, b in ((size + 1, 0), (size, 0), (size, 1)))
            long[at] = True
        if not long.any():
            break
        before, string, context = before[long], string[long], context[long]
        place = np.unique(before, return_index=True)[1]  # one row per different continuation
        strings, _, (n,) = _grouped(string[place], np.ones(len(place)))
        first = np.unique(string, return_index=True)[1]
        _, back, (total, freed) = _grouped(context[first], n, np.minimum(n, LOW_DISCOUNT))
        at = np.searchsorted(strings, string)
        h = back[at]
        p[long] = (np.maximum(n[at] - LOW_DISCOUNT, 0) + freed[h] * p[long]) / total[h]
    return p


class Model:
    """Log ratios (toxic over ordinary) of n-grams, of the unseen characters of contexts, and the calibration."""

    def __init__(self, words: list[str], ordinary: np.ndarray, toxic: np.ndarray):
        counted = np.flatnonzero(ordinary + toxic > 0)
        words, ordinary, toxic = [words[i] for i in counted], ordinary[counted], toxic[counted]
        parts = []
        for part, spelled in _chunks(words):
            gram, context = spelled.grams()
            found, _, n = _grouped(gram, ordinary[part][spelled.word], toxic[part][spelled.word])
            parts.append((found, context[np.unique(gram, return_index=True)[1]], *n))
        if parts:
            gram, context, *n = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            gram, context, *n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        del parts
        self.grams, _, n = _grouped(gram, *n)
        context = context[np.unique(gram, return_index=True)[1]]
        del gram
        pooled = n[0] + n[1]
        parts = [*n, pooled, *[np.minimum(x, DISCOUNT) for x in n], np.minimum(pooled, LOW_DISCOUNT)]
        self.contexts, h, (t0, t1, t, f0, f1, f) = _grouped(context, *parts)
        del context, parts
        shared = (np.maximum(pooled - LOW_DISCOUNT, 0) + f[h] * backoff(words, self.grams)) / t[h]
        # The weight of the shared model is 1 for a class that has never seen the context.
        weight = [np.where(a > 0, b / np.maximum(a, 1e-9), 1.0) for a, b in ((t0, f0), (t1, f1))]
        p = [np.maximum(x - DISCOUNT, 0) / np.maximum(a, 1e-9)[h] + w[h] * shared for x, a, w in zip(n, (t0, t1), weight, strict=True)]
        self.seen = (np.log(p[1]) - np.log(p[0])).astype(np.float32)
        self.unseen = (np.log(weight[1]) - np.log(weight[0])).astype(np.float32)
        self.slope, self.offset = 0.0, 0.0
        self._words: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under the toxic model minus that under the ordinary one."""
        spelled = Spelled(words)
        gram, context = spelled.grams()
        out = np.zeros(len(gram))
        known = np.zeros(len(gram), dtype=bool)
        for keys, values, asked in ((self.grams, self.seen, gram), (self.contexts, self.unseen, context)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = ~known & (keys[at] == asked)
                out[hit] = values[at[hit]]
                known |= hit
        return np.bincount(spelled.word, weights=out, minlength=len(words))

    def difference(self, texts: list[str | None]) -> np.ndarray:
        """Length-normalised log-likelihood of each text under the toxic mixture minus that under the ordinary model."""
        out, at = [np.zeros(0)], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= SLICE_CHARS):
                size += len(texts[end] or "")
                end += 1
            out.append(self._slice(texts[at:end]))
            at = end
        return np.concatenate(out)

    def _slice(self, texts: list[str | None]) -> np.ndarray:
        known = self._words
        if len(known) > CACHE:
            known.clear()
        found = [tokens(t) for t in texts]
        new = sorted(set().union(*found).difference(known)) if found else []
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            known.update(zip(part, np.log1p(SHARE * np.expm1(np.minimum(self.ratios(part), 500.0))).tolist(), strict=True))
        out = np.array([sum(sorted(map(known.__getitem__, w))) / len(w) if w else 0.0 for w in found])
        for w in new:
            if len(w) > CACHED_LENGTH:
                del known[w]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.difference(texts) * self.slope + self.offset, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, share: float, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic regression by Newton steps; classes weigh as among all labels."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    scale = x.std() or 1.0
    z = np.c_[x / scale, np.ones(len(x))]
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + 1e-2 * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w -= np.linalg.solve(h, g)
    return float(w[0] / scale), float(w[1])


def _word_docs(batches):
    """Rows (word, label, counted, documents) of a task's documents."""
    docs: Counter = Counter()
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in ("label", "counted", "text")], strict=True)
        for label, counted, text in rows:
            docs.update((w, label, counted) for w in tokens(text))
    types = (pa.string(), pa.int32(), pa.bool_())
    keys = zip(*docs, strict=True) if docs else ([], [], [])
    columns = [pa.array(list(k), t) for k, t in zip(keys, types, strict=True)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array(list(docs.values()), pa.int64())], ["word", "label", "counted", "n"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """The model from at most ``limit`` / 2 labelled rows of either class, with at most ``max_chars`` / 2 characters.

    The calibration is fitted on a quarter of them by a model of the others; the model returned counts all.
    """
    train = fold(F.col("doc_id"), 5) != 0
    own = labels.where(train).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [labelled_sample(ship(docs), own, "toxic", F.col("toxic") == c, limit // 2, max_chars // 2) for c in (0, 1)]
    sample = parts[0].unionByName(parts[1]).repartition(SAMPLE_PARTITIONS, "doc_id")
    sample = cut(sample.withColumn("counted", F.pmod(F.xxhash64("doc_id", F.lit("kn")), F.lit(4)) != 0))
    share = labels.where(train).agg(F.avg("toxic")).first()[0]
    share = float(np.clip(0.1 if share is None else share, 0.01, 0.99))
    total = lambda *given: F.sum(F.when(F.expr(" AND ".join(given)), F.col("n")).otherwise(0))
    sums = [total(f"label = {c}", *more).alias(f"{name}{c}") for name, more in (("n", ("counted",)), ("all", ())) for c in (0, 1)]
    found = sample.mapInArrow(_word_docs, "word string, label int, counted boolean, n long").groupBy("word").agg(*sums).toArrow()
    words, counts = found["word"].to_pylist(), {c: found[c].to_numpy().astype(float) for c in found.column_names[1:]}
    model = Model(words, counts["n0"], counts["n1"])
    seen = sample.where("NOT counted").select("label", _difference(model)("text").alias("d")).toArrow()
    y, x = seen["label"].to_numpy().astype(float), seen["d"].to_numpy()
    del found, model
    model = Model(words, counts["all0"], counts["all1"])
    model.slope, model.offset = calibrate(x, y, share) if len(set(y)) == 2 else (0.0, float(np.log(share / (1 - share))))
    return model


def _difference(model: Model):
    @F.pandas_udf("double")
    def difference(text: pd.Series) -> pd.Series:
        return pd.Series(model.difference(text.tolist()))

    return difference


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score, predicted and held_out.  The model goes to the tasks as a broadcast of bounded size."""
    shared = ship(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(text.tolist()))

    return docs.select(
        *without(docs, {"held_out", "score", "predicted"}),
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        score("text").alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels)).select("doc_id", "held_out", "score", "predicted")
