"""Helpers the operators share: saved intermediate tables, Arrow batches cut to a size, one column as Python strings."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conflux.session import work_folder

# Bytes of text that a Python task turns into arrays at a time.
CHUNK_BYTES = 2_000_000


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there and Spark knows its size."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(df: DataFrame) -> DataFrame:
    """``df``, a table that grows with the documents, to be joined to their texts by sorting both at every size.

    Broadcasting it as long as it is small would only put off the shuffle of the texts to where it costs most.
    """
    return df.hint("merge")


def packed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns in one struct, so that added columns can't clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def text_column(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` bytes; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def text_key(*columns: Column) -> list[Column]:
    """96 bits that stand for the columns' values."""
    return [F.xxhash64(*columns), F.hash(*columns)]


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where it lies for the driver, if it isn't installed for them."""
    environment = spark.sparkContext.environment
    root, paths = str(Path(__file__).resolve().parents[2]), environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def arrow_map(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str
) -> DataFrame:
    """``df.mapInArrow`` by workers that find this package."""
    importable(df.sparkSession)
    return df.mapInArrow(fn, schema)
