"""Corpus preparation in five stages, each one operator of clipflow.llm applied to all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again before the next one.
All but the last return the columns of ``documents``; the last returns digests of the ids and of the decoded texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipflow.llm import bpe, decontaminate, quality_classifier, secret_scans, simhash
from clipflow.llm.common import staged, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    return quality_classifier.keep(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies."""
    return simhash.deduplicate(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark window occurs in."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secret_scans.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests, after decoding."""
    return bpe.digests(docs, bpe.vocabulary_path())


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", not_in_benchmark),
    ("secret scans", without_secrets),
    ("bpe", encoded),
]

#: SQL expresses neither the classifier nor the encoder; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
