import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from contactloom.llm import exact_dedup, mixing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"text  number {k % 7}\tand\nso on", "en", f"s{k % 3}", 1) for k in range(60)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " ", "en", "s0", 1), (103, "  ", "en", None, 2)]
    rows += [(7, "text number 0 and so on", "en", "s1", 1), (None, "alone", "en", "s1", 1), (None, "text number 0 and so on", "en", "s1", 1)]
    rows += [(200, "word " * 30_000, "en", "s2", 1), (5, "text  number 5\tand\nso on", "en", "s2", 1)]
    return frame(spark, rows).cache()


def brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub(" ", r.text or "")].append(r.doc_id)
    return groups


def test_exact_dedup_agrees_with_brute_force(docs):
    rows = docs.collect()
    groups = brute_groups(rows)
    found = exact_dedup.decide(docs).collect()
    assert len(found) == len(rows)
    kept = Counter()
    for r in found:
        norm = SPACE.sub(" ", r.text or "")
        ids = [i for i in groups[norm] if i is not None]
        assert r.keep_id == (min(ids) if ids else None)
        assert r.group_size == len(groups[norm])
        assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()
        kept[norm] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert exact_dedup.deduplicate(docs).count() == len(groups)
    assert exact_dedup.deduplicate(docs).columns == docs.columns
    assert exact_dedup.decide(docs, carry=False).where("kept").count() == len(groups)


def test_exact_dedup_of_an_empty_and_a_clashing_table(spark, docs):
    assert exact_dedup.decide(docs.limit(0)).count() == 0
    clash = docs.withColumns({"kept": F.lit("x"), "keep_id": F.lit("y"), "__n": F.lit(1)})
    found = exact_dedup.decide(clash.drop("__n"))
    assert dict(found.dtypes)["kept"] == "boolean" and found.count() == docs.count()
    same = exact_dedup.deduplicate(clash)
    assert same.columns == clash.columns and same.where("kept <> 'x'").count() == 0


def water_filling(sizes, weights, budget, limit):
    targets, open_ = {}, dict(sizes)
    left = budget
    while open_:
        total = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / total for s in open_}
        over = [s for s in open_ if share[s] > limit * open_[s]]
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = limit * open_.pop(s)
            left -= targets[s]
    return targets


def test_mixing_meets_its_targets(spark):
    rows = [(k, " ".join(["w"] * (1 + k * 7919 % 60)), "en", f"s{min(k % 40, 6)}" if k % 40 else None, 1) for k in range(4000)]
    found = mixing.plan(frame(spark, rows)).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    names = sorted((s for s in size if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    targets = water_filling(size, weights, 1.5 * sum(size.values()), 2)
    taken = Counter()
    for r in found:
        assert r.size == len(r.text.split()) and r.source_size == size[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert abs(taken[s] - targets[s]) <= 61 * 2
    again = mixing.plan(frame(spark, rows[::-1])).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in found}


def test_mixture_repeats_documents(docs):
    planned = mixing.plan(docs)
    assert mixing.mix(docs).count() == planned.agg({"copies": "sum"}).first()[0]
    assert mixing.mix(docs).columns == docs.columns
    assert planned.where("source_size = 0 AND taken > 0").count() == 0


def test_mixing_of_empty_tables_and_clashing_names(spark, docs):
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0
    clash = docs.withColumns({"size": F.lit("x"), "copies": F.lit("y")})
    assert mixing.mix(clash).columns == clash.columns and mixing.mix(clash).where("size <> 'x'").count() == 0
    blank = frame(spark, [(1, None, None, "a", 0), (2, " ", None, "b", 0)])
    assert [(r.target, r.taken) for r in mixing.plan(blank).collect()] == [(0.0, 0), (0.0, 0)]


def brute_statistics(text):
    words = [w for w in SPACE.split(text or "") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if SPACE.sub("", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y z x y z x", "é ü | <b> 100% #tag\nline\nline\n\nline ",
    "\nlead\r\nlead\r\n", "one two three\x0bfour\x0cone two three", "words " * 30_000, "a\u00a0b c\u2003d", "q w e r t y " * 3 + "\n" * 5,
]


def test_statistics_agree_with_brute_force(spark):
    rows = frame(spark, [(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in quality_rules.statistics(rows).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(TEXTS[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def varied(k, n=60):
    return [f"w{k}x{i * i % 97}{i}" for i in range(n)]


def test_learned_list_separates_planted_junk(spark):
    rows, labels = [], []
    for k in range(300):
        words = varied(1000 + k)
        kind = k % 5
        if kind == 0:
            words = [w + "%%%" for w in words]
        if kind == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, int(kind > 1), 0))
    rows.append((900, "short", "en", "s", 1))
    judged = quality_rules.judge(frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int"))
    assert {r.doc_id: r.kept for r in judged.collect()} == {k: k % 5 > 1 for k in range(300)} | {900: False}


def test_without_labels_the_base_rule_decides(spark, docs):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    judged = quality_rules.judge(docs, none)
    assert judged.where("kept = base_failed").count() == 0 and judged.count() == docs.count()
    assert quality_rules.judge(docs.limit(0), none).count() == 0
    clash = quality_rules.judge(docs.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit("y")), none)
    assert dict(clash.dtypes)["kept"] == "boolean" and dict(clash.dtypes)["n_words"] == "bigint"


def test_filters_on_a_verdict_stay_linear(spark):
    rows = frame(spark, [(1, " ".join(varied(1, 20_000)))], "doc_id long, text string")
    assert quality_rules.statistics(rows).where("NOT base_failed").count() == 1
