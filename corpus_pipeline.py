"""A corpus from ``documents``: language, repeated lines, near copies, benchmark passages, and the mix of sources.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the next
one's documents. ``run`` applies them to the table ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from conflux.llm.decontaminate import without_benchmark
from conflux.llm.langid import keep_identified, train
from conflux.llm.line_dedup import deduplicated
from conflux.llm.mixing import in_mixed_order, mixed
from conflux.llm.simhash import one_of_each
from conflux.llm.tables import saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no text, no letter, or two languages about as likely.

    The classifiers learn from all documents whose ``lang`` is not null; without any, nothing can be told.
    """
    return keep_identified(docs, train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that stand in many sources out of all documents but the first, and drops documents that consist of them."""
    return deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (three-word shingles, up to three different bits): the one with the smallest id."""
    return one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, word for word or reworded."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in an order that mixes their sources by the square roots of their sizes; adds ``mix_position``."""
    return in_mixed_order(mixed(docs))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("mix", mix),
]

# SQL can't express the classifiers, the fingerprints' components and the schedule.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
