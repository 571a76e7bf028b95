import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactloom.llm import quality_classifier, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    syllables = ["ba", "ko", "ri", "tu", "mel", "san", "dor", "fi"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    docs, labels = [], []
    for k in range(600):
        words = [word() for _ in range(rng.integers(40, 120))]
        toxic, quality = int(k % 4 == 0), int(k % 3 > 0)
        if toxic:
            for i in range(0, len(words), 12):
                words[i] = "vex" + word()
        if not quality:
            words = [w + "%%%" for w in words] if k % 2 else [w.upper() + "!!" for w in words]
        docs.append((k, " ".join(words), "xx", "s", 1))
        labels.append((k, quality, toxic))
    docs += [(None, None, None, None, None), (1000, "", "xx", "s", 0), (1001, "%%%", "xx", "s", 0), (1002, "kori " * 30_000, "xx", "s", 0), (1000, "", "xx", "s", 0)]
    return spark.createDataFrame(docs, DOCS).cache(), spark.createDataFrame(labels, LABELS).cache()


@pytest.mark.parametrize(
    ("operator", "label", "modulus", "held", "threshold"), [(toxicity, "toxic", 5, 0, 0.5), (quality_classifier, "quality", 4, 2, 0.7)]
)
def test_held_out_accuracy_and_odd_rows(tables, operator, label, modulus, held, threshold):
    docs, labels = tables
    judged = operator.judge(docs, operator.fit(docs, labels)).cache()
    assert judged.count() == docs.count()
    for r in judged.collect():
        text = "" if r.doc_id is None else str(r.doc_id)
        assert r.held_out == (zlib.crc32(text.encode()) % modulus == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    test = judged.where("held_out").join(labels, "doc_id").select("predicted", F.col(label).alias("y")).collect()
    assert len(test) > 50 and np.mean([r.predicted == r.y for r in test]) > 0.95


@pytest.mark.parametrize("operator", [toxicity, quality_classifier])
def test_missing_labels_empty_tables_and_clashing_names(spark, tables, operator):
    docs, labels = tables
    model = operator.fit(docs, labels.limit(0))
    assert operator.judge(docs.limit(0), model).count() == 0
    clash = operator.judge(docs.limit(5).withColumn("score", F.lit("x")), model)
    assert dict(clash.dtypes)["score"] == "double" and clash.count() == 5
    one_class = operator.fit(docs, labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)}))
    assert len({r.score for r in operator.judge(docs, one_class).collect()}) == 1


def test_rejected_documents_go(tables):
    docs, labels = tables
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_repeats_are_the_same_for_the_same_rows(tables):
    docs, labels = tables
    a, b = (quality_classifier.judge(docs, quality_classifier.fit(d, labels)).where("doc_id < 9").orderBy("doc_id").collect() for d in (docs, docs.repartition(3)))
    assert [r.score for r in a] == pytest.approx([r.score for r in b], abs=1e-9)


URLS = [
    ("https://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    ("https://www.example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://other.com/x", "other.com", "/x", "com/", "allow"),
    ("http://other.com", "other.com", "", None, None),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"),
    ("http://a.net/es", "a.net", "/es", None, None),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://x.org#a/b", "x.org", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("http://ÀB.org/É", "Àb.org", "/É", None, None),
    ("http://\nx.org/\np", "\nx.org", "/\np", None, None),
]


def test_urls_are_split_and_rules_win(spark):
    df = spark.createDataFrame([(k, u[0], "x") for k, u in enumerate(URLS)], "page_id long, url string, rule string")
    for r in url_filter.judge(df).collect():
        _, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
        assert url_filter.split_url(r.url) == (host, path)
    assert url_filter.judge(df.limit(0)).count() == 0
