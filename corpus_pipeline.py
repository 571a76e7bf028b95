"""Corpus pipeline: classify, deduplicate twice, mix, and encode the documents.

Each stage works on all rows that the one before it kept, is written as Parquet to the
cluster's shared folder and read again, so a lost executor costs one stage's tasks.

Defined cases: an empty table gives an empty result; null and empty texts, of whatever
verdict, pass through the stages like others (the classifier scores
the zero vector, equal ones are duplicates, their size in the mixture is 0); null ids lose against any other id;
texts of any length are read whole; extra columns are carried to the end.  The last stage
drops the text and adds ids, n_tokens, decoded_chars and round_trip, which replace columns of these
names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from contactloom.llm import exact_dedup, mixing, piece_tokenizer, quality_classifier, simhash_dedup
from contactloom.llm.common import shared_folder


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return simhash_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents as often as their source's target asks for."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents with their piece ids, decoded again as a check."""
    return piece_tokenizer.encode_and_check(docs).drop("text")


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", deduplicate),
    ("SimHash near-dedup", near_deduplicate),
    ("mixing", mix),
    ("SentencePiece", tokenize),
]

#: The classifier, the fingerprints and the pieces can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
