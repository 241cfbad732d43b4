"""Starting streaming queries and getting their results back as tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from conflux.session import is_local, work_folder
from conflux.streaming.progress import kept_reports

# State on disk, saved by changes instead of whole files, one store per partition and join rather than
# four, and without a lookup per write to keep count of the rows.
_SPILLING = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@dataclass(frozen=True)
class Run:
    """How a streaming query is run.

    every       trigger interval such as "12 seconds"; None processes what is there, then stops
    timeout     seconds after which the query is stopped; None waits for its end
    partitions  state partitions, fixed for the life of a checkpoint (a restart goes on with those it began with), see
                ``state_partitions``; None takes the session's shuffle partitions, on a local session one per core
    spill       keep join state in RocksDB on the executors' disks rather than in JVM memory
    closing_batch  whether a last micro-batch without rows may follow, in which Spark acts on the final
                watermark; needed where windows are only given out once they are closed
    reports     a folder in the shared file system that each progress report is appended to; a later run may add to it
    """

    every: str | None = None
    timeout: float | None = None
    partitions: int | None = None
    spill: bool = True
    closing_batch: bool = True
    reports: str | None = None


@contextmanager
def _settings(spark: SparkSession, **settings: str) -> Iterator[None]:
    """Set session options for a while: a streaming query keeps those in force when it starts."""
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def start(writer: DataStreamWriter, spark: SparkSession, run: Run) -> StreamingQuery:
    trigger = {"processingTime": run.every} if run.every else {"availableNow": True}
    partitions = run.partitions
    if partitions is None and is_local(spark):
        partitions = spark.sparkContext.defaultParallelism
    settings = {}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    if not run.closing_batch:
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    if run.spill:
        settings.update(_SPILLING)
    with _settings(spark, **settings):
        return writer.trigger(**trigger).start()


class CutShort(UserWarning):
    """A run was stopped by its timeout: what it gives is what there was by then."""


def finish(query: StreamingQuery, run: Run) -> StreamingQuery:
    """Wait for the query's end or its timeout; failures of the query are raised here.

    Stopping at a timeout gives a ``CutShort`` warning, except for periodic runs, which have no other end.
    """
    try:
        if run.timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(run.timeout) and not run.every:
            warnings.warn(f"{query.name} was stopped after {run.timeout} s and did not read all", CutShort, stacklevel=3)
    finally:
        query.stop()
    return query


def _run(writer: DataStreamWriter, spark: SparkSession, run: Run) -> StreamingQuery:
    with kept_reports(spark, run.reports) as keep:
        query = keep(start(writer, spark, run))
        return finish(query, run)


def run_to_table(df: DataFrame, name: str, run: Run = Run(), folder: str | None = None) -> DataFrame:
    """Run a stream in append mode into Parquet files and return them as a DataFrame.

    With the ``folder`` of an earlier run it goes on from that run's checkpoint; every row comes out
    once even if a micro-batch had to be repeated.
    """
    spark = df.sparkSession
    folder = folder or work_folder(spark, name)
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .queryName(f"{name}-{folder[-8:]}")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/rows")
    )
    _run(writer, spark, run)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def run_batches(
    df: DataFrame,
    name: str,
    each: Callable[[DataFrame, int], None],
    run: Run = Run(),
    mode: str = "append",
    folder: str | None = None,
) -> StreamingQuery:
    """Run a stream, handing every micro-batch and its number to ``each``.

    After a failure the last micro-batch may be handed over again, so ``each`` must write by batch
    number (see BatchFolder).
    """
    spark = df.sparkSession
    folder = folder or work_folder(spark, name)
    writer = (
        df.writeStream.foreachBatch(each)
        .outputMode(mode)
        .queryName(f"{name}-{folder[-8:]}")
        .option("checkpointLocation", f"{folder}/checkpoint")
    )
    return _run(writer, spark, run)


def run_to_console(df: DataFrame, run: Run = Run(), rows: int = 20) -> StreamingQuery:
    """Print the first rows of every micro-batch on the driver's console."""
    spark = df.sparkSession
    writer = (
        df.writeStream.format("console")
        .outputMode("append")
        .option("numRows", rows)
        .option("truncate", False)
        .option("checkpointLocation", f"{work_folder(spark, 'console')}/checkpoint")
    )
    return _run(writer, spark, run)
