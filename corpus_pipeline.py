"""The corpus pipeline: stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rolesift.llm.common import documents, prepare, shared_folder  # noqa: E402
from rolesift.llm.decontaminate import drop_contaminated  # noqa: E402
from rolesift.llm.language import held_out, keep_identified, learn_least, learn_profiles  # noqa: E402
from rolesift.llm.ngram_join import keep_one  # noqa: E402
from rolesift.llm.packing import pack  # noqa: E402
from rolesift.llm.pii import sanitise  # noqa: E402


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or unlike every learned language, go; all others stay as they are.

    Profiles are learned from the labelled documents that are not held out, the least scores from those that are.
    """
    prepare(spark)
    profiles = learn_profiles(docs.filter(~held_out()))
    return keep_identified(docs, profiles, learn_least(docs.filter(held_out()), profiles))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one with the least doc_id."""
    prepare(spark)
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark`` go."""
    return drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data and terms that disclose it are replaced in its text."""
    prepare(spark)
    return sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    prepare(spark)
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_join", ngram_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Learned profiles and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's result is a written table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
