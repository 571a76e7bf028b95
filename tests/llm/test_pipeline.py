import random

import corpus_pipeline
from contactloom.llm import exact_dedup, quality_classifier, simhash_dedup


def make(spark, folder):
    rng, rows, labels = random.Random(8), [], []
    for k in range(400):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        if k % 4 == 0:
            words = [w + "&&&" for w in words]
        rows.append((k, " ".join(words), "en", f"s{k % 3}" if k % 2 else "hot", 1))
        labels.append((k, int(k % 4 > 0), 0))
    rows += [(500 + k, rows[1][1] + " ", "en", "s1", 1) for k in range(20)] + [(600, rows[2][1] + " more", "en", "s1", 1), (700, None, None, None, None), (701, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_agree_with_their_decisions(spark, tmp_path):
    make(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, seen, str(tmp_path)).cache()
        assert made.columns == docs.columns, name
        if stage is corpus_pipeline.classify:
            labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
            judged = quality_classifier.judge(seen, quality_classifier.fit(seen, labels))
            assert sorted(map(str, made.collect())) == sorted(map(str, judged.where("predicted = 1").select(*docs.columns).collect()))
            assert made.where("doc_id % 4 <> 0 AND doc_id < 400").count() > 290
        if stage is corpus_pipeline.deduplicate:
            assert made.count() == exact_dedup.decide(seen).select("text_sha256").distinct().count()
            assert made.where("doc_id BETWEEN 500 AND 519").count() <= 1
        if stage is corpus_pipeline.near_deduplicate:
            assert made.count() == simhash_dedup.decide(seen).select("component_id").distinct().count()
        if stage is corpus_pipeline.mix:
            assert 1.2 < made.count() / seen.count() < 1.8
        seen = made
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.count() == seen.count() and last.where("NOT round_trip").count() == 0
