import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from contactloom.llm import toxicity

WORDS = {"idiot": (0, 6), "ideal": (5, 1), "the": (9, 8), "then": (4, 5), "thin": (3, 0), "a": (7, 7), "ärger": (1, 3), "thintheidiots": (0, 2)}


def plain_ratio(word, counts):
    """Log ratio of one word by Kneser-Ney counts in dictionaries, straight from the definition."""
    order, low, d, dl = toxicity.ORDER, toxicity.LOW, toxicity.DISCOUNT, toxicity.LOW_DISCOUNT
    marked = lambda w: f"^{w}$"
    grams = defaultdict(lambda: [0, 0])
    for w, pair in counts.items():
        m = marked(w)
        for i in range(1, len(m)):
            for c in (0, 1):
                grams[m[max(0, i + 1 - order) : i + 1]][c] += pair[c]
    context = defaultdict(set)
    for g in grams:
        context[g[:-1]].add(g)

    def continuation(g):
        p = 1 / 256
        for size in range(1, low + 1):
            if len(g) <= size:
                break
            before = {x[-size - 1 :] for x in grams if len(x) > size}
            n = Counter(x[1:] for x in before)
            h = g[-size:-1]
            same = [k for s, k in n.items() if s[:-1] == h]
            p = (max(n[g[-size:]] - dl, 0) + sum(min(k, dl) for k in same) * p) / sum(same)
        return p

    total = 0.0
    m = marked(word)
    for i in range(1, len(m)):
        g = m[max(0, i + 1 - order) : i + 1]
        h = g[:-1]
        if h not in context:
            continue
        pooled = [sum(grams[x]) for x in context[h]]
        shared = 1.0  # cancels out where neither class has seen the character
        if g in grams:
            shared = (max(sum(grams[g]) - dl, 0) + sum(min(k, dl) for k in pooled) * continuation(g)) / sum(pooled)
        p = []
        for c in (0, 1):
            seen = [grams[x][c] for x in context[h]]
            own = grams[g][c] if g in grams else 0
            p.append((max(own - d, 0) + sum(min(k, d) for k in seen) * shared) / sum(seen) if sum(seen) else shared)
        total += math.log(p[1] / p[0])
    return total


def model():
    words = sorted(WORDS)
    return toxicity.Model(words, *[np.array([WORDS[w][c] for w in words], dtype=float) for c in (0, 1)])


def test_ratios_follow_the_definition():
    asked = ["idiot", "idiots", "the", "thinner", "ärgern", "zebra", "thintheidiots", "x" * 40, "a"]
    assert model().ratios(asked) == pytest.approx([plain_ratio(w, WORDS) for w in asked], abs=1e-5)


def test_texts_are_scored_by_the_mean_over_their_words():
    made = model()
    texts = ["the idiot", "the the the", "", None, "...", "x" * 100_000, "the " * 50_000 + "idiot"]
    want = []
    for t in texts:
        words = toxicity.tokens(t)
        want.append(sum(math.log1p(toxicity.SHARE * math.expm1(made.ratios([w])[0])) for w in words) / len(words) if words else 0.0)
    assert made.difference(texts) == pytest.approx(want, abs=1e-9)
    assert made.difference(texts) == pytest.approx(want, abs=1e-9)  # from the cache
    assert made.difference([]).size == 0


def test_all_grams_of_the_sample_are_counted(spark):
    rows = [(k, f"word{k} other{k % 7}") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    fitted = toxicity.fit(docs, labels)
    used = [t for k, t in rows if __import__("zlib").crc32(str(k).encode()) % 5]
    marked = {f"^{w}$" for t in used for w in t.split()}
    assert len(fitted.grams) == len({m[max(0, i + 1 - toxicity.ORDER) : i + 1] for m in marked for i in range(1, len(m))})


def test_the_sample_is_bounded_in_rows_and_characters(spark):
    from pyspark.sql import functions as F

    from contactloom.llm.common import labelled_sample

    docs = spark.createDataFrame([(k % 5, "x" * 10 + str(k)) for k in range(100)] + [(7, None), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0) for k in range(5)] + [(2, 1), (7, 1), (None, 1)], "doc_id long, toxic int")
    take = lambda rows, chars: labelled_sample(docs, labels, "toxic", F.lit(True), rows, chars).collect()
    assert len(take(200, 10_000)) == 101 and {r.label for r in take(200, 10_000) if r.doc_id == 2} == {1}
    assert len(take(30, 10_000)) == 30 and take(30, 10_000) == take(30, 10_000)
    assert 0 < sum(len(r.text or "") for r in take(200, 50)) <= 50
