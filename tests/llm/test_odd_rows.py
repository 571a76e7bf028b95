"""Odd rows, odd names and odd sizes of the training-data operators."""

import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contactloom.llm import chat_format, common, exact_dedup, mixing, piece_tokenizer, quality_rules, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(k % 70, rng.choice(["a b", "a  b", "b a", "", None, f"own {k}"]), "en", rng.choice(["x", None]), 1) for k in range(200)]
    rows += [(None, t, None, None, None) for t in ("a\tb", "null id", None)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("carry", [True, False])
def test_exact_dedup_compares_texts_even_if_digests_collide(docs, carry):
    weak = lambda norm: F.substring(F.sha2(norm, 256), 1, 1)
    found = exact_dedup.decide(docs, carry=carry, digest=weak).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[SPACE.sub(" ", r.text or "")].append(r.doc_id)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    rows = [(i, least[t], len(ids)) for t, ids in groups.items() for i in ids]
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == Counter(rows)
    assert sum(r.kept for r in found) == len(groups)


def test_columns_with_odd_names_are_carried(spark, docs):
    odd = docs.withColumns({"__n": F.lit(1), "__salt": F.lit("s"), "digest": F.lit(2), "c0": F.lit(3), "id": F.lit(4), "a.b": F.lit(5)})
    found = exact_dedup.decide(odd)
    assert found.columns == [*odd.columns, *exact_dedup.OUTPUT] and found.where("__n = 1 AND __salt = 's' AND `a.b` = 5").count() == docs.count()
    assert exact_dedup.deduplicate(odd).columns == odd.columns
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int")
    ratios = docs.withColumns({"symbol_ratio": F.lit("mine"), "__w": F.lit(1), "n_words": F.lit("x"), "c1": F.lit(7)})
    judged = quality_rules.judge(ratios, labels)
    assert judged.where("symbol_ratio = 'mine' AND __w = 1 AND c1 = 7").count() == docs.count() and dict(judged.dtypes)["n_words"] == "bigint"
    near = docs.withColumns({"fp": F.lit("x"), "component_id": F.lit("y"), "salt": F.lit("z")})
    assert simhash_dedup.decide(near).columns == ["doc_id", "fp", "component_id"]
    assert simhash_dedup.keep_one(near).columns == near.columns


def test_ids_may_be_text(spark):
    df = spark.createDataFrame([("b", "same text here"), ("a", "Same text  here"), (None, "same text here"), ("z", "another one")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in simhash_dedup.decide(df).collect()} == {("b", "a"), ("a", "a"), (None, "a"), ("z", "z")}
    said = spark.createDataFrame([("u", 0, "user", "hi"), ("v", 0, "assistant", "ho")], "conv_id string, turn int, role string, text string")
    found = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.digests(chat_format.format_conversations(said)).collect()}
    assert found == {"u": (1, 0), "v": (1, 2)}


def test_many_copies_of_one_fingerprint_and_one_giant_component(spark):
    rows = [(k, "the very same words", None, None, None) for k in range(3000)] + [(5000, "other words altogether now", None, None, None)]
    found = simhash_dedup.decide(spark.createDataFrame(rows, SCHEMA)).groupBy("component_id").count().collect()
    assert {(r.component_id, r["count"]) for r in found} == {(0, 3000), (5000, 1)}


def test_mixture_comes_near_its_targets_with_null_and_equal_ids(spark):
    rng = random.Random(2)
    size = lambda: int(rng.paretovariate(1.1) * 5) % 4000
    rows = [(rng.choice([None, None, 7, k]), " ".join(["w"] * size()) + f" u{k}", "en", rng.choice(["a", "b", "c", None]), 1) for k in range(1500)]
    rows += [(1, "only words", "en", "tiny", 1), (2, None, "en", "none", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for plan in (mixing.plan(df), mixing.plan(df, carry=False)):
        for r in plan.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m"), F.max(F.expr("taken - 2 * size")).alias("x")).collect():
            assert abs(r.t - r.g) < 2 * r.m + 1e-6 and r.x <= 0, r
    a, b = (sorted(map(str, mixing.plan(d, carry=False).drop("text").collect())) for d in (df, df.repartition(7)))
    assert a == b


def test_long_conversations_are_located_in_time():
    turns = [("user" if k % 2 else "assistant", f"text {k} ### </turn> \\") for k in range(3000)]
    start = time.process_time()
    row = chat_format.formatted_row(turns)
    assert time.process_time() - start < 60
    assert chat_format.parse(row["formatted"]) == turns and row["rewritten_at"] is None
    assert [chat_format.unescape(row["formatted"][a:b]) for a, b in row["loss_spans"]] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize(
    "template",
    [
        chat_format.template,
        lambda t: "".join(f"[{r}]{x}[/]" for r, x in t) + "(end)",
        lambda t: "".join(f"{len(x)}:{x};" for _, x in t),
        lambda t: "".join(f"<{r}>" + "".join(c for c in x if c < "") + "|" for r, x in t),
    ],
)
def test_texts_are_found_in_other_templates(template):
    turns = [("user", "ab"), ("assistant", "b"), ("assistant", ""), ("user", "x"), ("assistant", "abab")]
    output, _, texts, _ = chat_format.render(turns, template)
    shown = [template(turns[: k + 1])[a:b] for k, (a, b) in enumerate(texts)]
    assert [s.split(":")[-1] for s in shown] == [t for _, t in turns]
    assert output == template(turns)


def test_common_prefixes():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(400)))
        b = a[: rng.randrange(len(a) + 1)] + "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        want = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert chat_format._common(a, b) == want == chat_format._common(a, b, min(want, 3))


def test_units_without_blanks_do_not_fill_the_cache():
    with open(piece_tokenizer.MODEL, "rb") as f:
        vocab = piece_tokenizer.Vocabulary(f.read())
    texts = ["字" * 4000 + str(k) for k in range(5)] + ["short words"]
    ids = vocab.encode(texts)
    assert [vocab.decode(x.tolist()) for x in ids] == texts
    assert max(map(len, vocab.cache)) <= piece_tokenizer.CACHED_LENGTH


def test_a_cluster_must_name_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = type("Conf", (), {"get": lambda self, key, default=None: default})()

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())


def write(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_of_an_empty_table(spark, tmp_path):
    write(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_long_texts_nulls_and_clashing_names(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, " ".join(f"w{rng.randrange(400)}{'&&&' * (k % 4 == 0)}" for _ in range(50)), "en", "s", 1, "x", 2) for k in range(40)]
    rows += [(50, "long words " * 40_000, "en", "s", 1, "x", 2), (None, None, None, None, None, None, None), (51, "", "en", "s", 0, "x", 2)]
    write(spark, tmp_path, rows, SCHEMA + ", ids string, kept int")
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.where("NOT round_trip").count() == 0 and found.count() > 0
    assert dict(found.dtypes)["ids"] == "array<int>" and dict(found.dtypes)["kept"] == "int"


def test_rules_decide_as_in_plain_python_and_the_best_threshold_is_found(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(240):
        bad = k % 3 == 0
        words = [rng.choice("abcdefgh") * rng.randrange(1, 7) + ("!" if bad and k % 2 and rng.random() < 0.6 else "") + ("#$" if bad and not k % 2 and rng.random() < 0.5 else "") for _ in range(80)]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), 0))
    df = spark.createDataFrame([*rows, (500, None), (501, "few words")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = quality_rules.training_rows(df, marks)
    rules = quality_rules.learn(train)
    assert len(rules) >= 2  # two kinds of bad texts need two rules
    stats = {r.doc_id: r.asDict() for r in quality_rules.statistics(df).collect()}
    want = {i: not r["base_failed"] and not any(quality_rules._holds(r, rule) for rule in rules) for i, r in stats.items()}
    found = {r.doc_id: r.kept for r in quality_rules.judge(df, marks).collect()}
    assert found == want and not found[500] and not found[501]
    truth = dict((i, y) for i, y, _ in labels)
    assert sum(found[i] == bool(y) for i, y in truth.items()) > 0.97 * len(truth)
    # One condition against all thresholds of all features.
    gain, (f, op, cut) = quality_rules._best_condition(train, quality_rules.FEATURES)
    import math

    bad = [r["label"] == 0 for r in train]
    before = math.log2(sum(bad) / len(bad))
    best = 0.0
    for feature in quality_rules.FEATURES:
        values = sorted({r[feature] for r in train})
        for a, b in zip(values, values[1:]):
            for side in ("<", ">="):
                hit = [y for r, y in zip(train, bad) if (r[feature] < (a + b) / 2) == (side == "<")]
                if sum(hit):
                    best = max(best, sum(hit) * (math.log2(sum(hit) / len(hit)) - before))
    assert gain == pytest.approx(best, abs=1e-5)
