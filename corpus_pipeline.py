"""A corpus pipeline over ``documents``: each stage filters what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlore.llm import decontam, langid, mixing, pii, simhash
from runlore.llm.common import table
from runlore.session import delete_path, new_path, temporary_tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not identified: no letter, or no language likely."""
    return langid.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component."""
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more of the words lie in benchmark windows."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; every document stays."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the target weights ask for: a row for each copy, none for copies 0."""
    return mixing.mixture(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mix),
]

# Language models, fingerprints and rounding by hashes have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again.

    Tables that a stage needs for itself go when it is done, and its input once its result is written. The
    last result stays until ``remove_tables`` or the end of the ``temporary_tables`` block around this call.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete_path(spark, before)
        before = path
    return docs
