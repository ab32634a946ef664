"""A corpus pipeline of five stages over ``documents``.

Quality classifier, near duplicates, benchmark decontamination, mixing to target weights, token-id files. Each stage
gets the Spark session, the documents its predecessor kept and the folder of the tables; all but the last return the
documents that stay, with their columns. Every stage's result is written as Parquet and read again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseframe.llm import decontamination, mixing, qda_quality, shingle_join, token_output
from pulseframe.llm.queries import END_ID, TOXIC_TARGETS, tokenizer_path, toxic_domain
from pulseframe.llm.run import table
from pulseframe.session import materialize, prepare


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return qda_quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return shingle_join.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), toxic_domain(), TOXIC_TARGETS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files of the mixed documents, read back: one row a document."""
    return token_output.token_files(docs, tokenizer_path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination), ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]
#: Trained stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
