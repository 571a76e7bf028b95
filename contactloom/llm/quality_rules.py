"""Quality rules: base statistics and a learned decision list (DataFrame functions only).

The statistics of a document come from its own words, lines and characters in one
projection without a shuffle.  A decision list is learned from the statistics of
labelled documents by sequential covering: each rule is grown as a conjunction of
thresholds by information gain on two thirds of the rows, pruned on the other
third, and kept while it stays precise; what it covers is taken away before the
next rule is grown.  The list is emitted as an ordered Spark CASE expression.

Repeated windows are found by sorting the 64-bit hashes of a text's three-word
windows, so the cost is n log n in the words of one text.

Defined cases: a null or blank text has 0 words and fails the base rule; without
labels the list is empty and the base rule decides; rows of one labelled id are all
learned from, within the bounds, and contradicting labels of an id count as good; extra
columns are carried and replaced only where an output column has their name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import SPACE, WORD, labelled_sample, without

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
FEATURES = ["symbol_ratio", "upper_ratio", "exclaim_ratio", "repeat_ratio", "dup_line_ratio", "mean_word"]
OUTPUT = [*BASE, "kept"]
#: Bounds of the labelled sample that the list is learned from.
MAX_ROWS = 4000
MAX_CHARS = 24_000_000
MIN_PRECISION = 0.95
MIN_COVER = 3


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``: evaluated once, also where the optimizer moves the whole expression."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _own_words(text: str) -> str:
    """Struct of n_words, word_chars and n_repeat_words of one text.

    The windows' hashes are sorted with their positions; a window stands twice or
    more if a neighbour has its hash, and then covers three positions.
    """
    windows = (
        "sort_array(transform(sequence(1, size(w) - 2), i -> struct("
        "xxhash64(element_at(w, i), element_at(w, i + 1), element_at(w, i + 2)) AS h, i AS p)))"
    )
    again = "filter(v, (x, i) -> coalesce(get(v, i + 1).h = x.h, false) OR coalesce(get(v, i - 1).h = x.h, false))"
    covered = f"size(array_distinct(flatten(transform({again}, x -> array(x.p, x.p + 1, x.p + 2)))))"
    counts = (
        "named_struct('n_words', CAST(size(w) AS BIGINT), 'word_chars', CAST(length(array_join(w, '')) AS BIGINT), "
        f"'n_repeat_words', CAST(CASE WHEN size(w) < 3 THEN 0 ELSE {_let(windows, 'v', covered)} END AS BIGINT))"
    )
    return _let(f"array_remove(split({text}, r'{SPACE}'), '')", "w", counts)


def _own_lines(text: str) -> str:
    """Struct of the lines with a word and of those equal to an earlier one."""
    counts = "named_struct('n', size(l), 'dup', CAST(size(l) - size(array_distinct(l)) AS BIGINT))"
    return _let(f"filter(split({text}, '\\n'), x -> x rlike r'{WORD}')", "l", counts)


def statistics(docs: DataFrame, text_col: str = "text", more: bool = True) -> DataFrame:
    """``docs`` with the base statistics and, with ``more``, the ratios that rules test."""
    held = f"coalesce(`{text_col}`, '')"
    text = F.expr(held)
    df = (
        docs.drop(*BASE, *FEATURES)
        .select("*", F.expr(_own_words(held)).alias("__w"), F.expr(_own_lines(held)).alias("__l"))
        .select(
            "*",
            "__w.*",
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.col("__l.dup").alias("n_dup_lines"),
        )
    )
    if more:
        per = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
        n, chars = F.col("n_words"), F.col("word_chars")
        df = df.select(
            "*",
            per(F.col("n_symbols"), n).alias("symbol_ratio"),
            per(F.regexp_count(text, F.lit(r"\p{Lu}")), chars).alias("upper_ratio"),
            per(F.regexp_count(text, F.lit("!")), n).alias("exclaim_ratio"),
            per(F.col("n_repeat_words"), n).alias("repeat_ratio"),
            per(F.col("n_dup_lines"), F.col("__l.n")).alias("dup_line_ratio"),
            per(chars, n).alias("mean_word"),
        )
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return df.withColumn("base_failed", failed).drop("__w", "__l")


Condition = tuple[str, str, float]


def _holds(row: dict, rule: list[Condition]) -> bool:
    return all(row[f] >= t if op == ">=" else row[f] < t for f, op, t in rule)


def _count(rows: list[dict], rule: list[Condition]) -> tuple[int, int]:
    hit = [r["label"] for r in rows if _holds(r, rule)]
    return hit.count(0), hit.count(1)


def _best_condition(rows: list[dict], features: list[str]) -> tuple[float, Condition] | None:
    """The threshold with the largest FOIL gain for the rejected class; of equal ones, that in the widest gap of its feature's range."""
    bad = sum(r["label"] == 0 for r in rows)
    if not bad or bad == len(rows):
        return None
    before, best = math.log2(bad / len(rows)), None
    for f in features:
        values = sorted((r[f], r["label"]) for r in rows)
        span = (values[-1][0] - values[0][0]) or 1.0
        p = n = 0
        for (v, label), (following, _) in zip(values, values[1:], strict=False):
            p, n = p + (label == 0), n + (label == 1)
            if v == following:
                continue
            cut = (v + following) / 2
            for op, a, b in (("<", p, n), (">=", bad - p, len(rows) - bad - n)):
                if a:
                    gain = a * (math.log2(a / (a + b)) - before)
                    merit = (round(gain, 6), (following - v) / span)
                    if best is None or merit > best[0]:
                        best = (merit, (f, op, cut))
    return best and (best[0][0], best[1])


def learn(rows: list[dict], features: list[str] | None = None) -> list[list[Condition]]:
    """Ordered rules that reject, from rows with ``label`` 0 (reject) or 1 (keep)."""
    features = features or FEATURES
    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if not i % 3]
    rules: list[list[Condition]] = []
    while True:
        rule: list[Condition] = []
        covered = grow
        while (found := _best_condition(covered, features)) and found[0] > 1e-6:
            rule.append(found[1])
            covered = [r for r in covered if _holds(r, rule)]
        if not rule:
            break

        def worth(k: int, rule=rule) -> float:
            p, n = _count(prune, rule[:k])
            return (p - n) / (p + n) if p + n else -1.0

        size = max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))
        rule = rule[:size]
        p, n = map(sum, zip(_count(grow, rule), _count(prune, rule), strict=True))
        if p < MIN_COVER or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule)
        grow = [r for r in grow if not _holds(r, rule)]
        prune = [r for r in prune if not _holds(r, rule)]
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS) -> list[dict]:
    """Statistics of at most ``limit`` labelled documents that pass the base rule, in a fixed order."""
    sample = statistics(labelled_sample(docs, labels, "quality", F.lit(True), limit, MAX_CHARS))
    found = sample.select(F.xxhash64("doc_id").alias("h"), "doc_id", "label", "base_failed", *FEATURES).collect()
    return [r.asDict() for r in sorted(found) if not r.base_failed]


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as a CASE expression: true keeps."""
    case = F.when(F.col("base_failed"), False)
    for rule in rules:
        holds = F.lit(True)
        for f, op, t in rule:
            holds = holds & (F.col(f) >= t if op == ">=" else F.col(f) < t)
        case = case.when(holds, False)
    return case.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """``docs`` with the base statistics and ``kept``."""
    rules = learn(training_rows(docs, labels, limit))
    names = [c for c in docs.columns if c.lower() not in OUTPUT]
    held = [f"c{i}" for i in range(len(names))]
    plain = docs.select(F.col("text").alias("text"), *[c.alias(h) for c, h in zip(without(docs, OUTPUT), held, strict=True)])
    judged = statistics(plain).withColumn("kept", verdict(rules))
    return judged.select(*[F.col(h).alias(c) for h, c in zip(held, names, strict=True)], *OUTPUT)


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, labels).select("doc_id", *OUTPUT)
