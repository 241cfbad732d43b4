"""Progress of streaming queries as a flat table."""

from __future__ import annotations

import threading
import time
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

_SCHEMA = """
    numInputRows BIGINT, processedRowsPerSecond DOUBLE,
    durationMs STRUCT<addBatch: BIGINT, getBatch: BIGINT, getOffset: BIGINT, latestOffset: BIGINT,
                      queryPlanning: BIGINT, triggerExecution: BIGINT, walCommit: BIGINT>,
    sources ARRAY<STRUCT<numInputRows: BIGINT, processedRowsPerSecond: DOUBLE>>
"""

# The columns of the report, in this order.
PROGRESS_COLUMNS = [
    "numInputRows",
    "processedRowsPerSecond",
    "addBatch",
    "getBatch",
    "getOffset",
    "queryPlanning",
    "triggerExecution",
    "walCommit",
    "numInputRowsA",
    "processedRowsPerSecondA",
    "numInputRowsB",
    "processedRowsPerSecondB",
]


def flatten_progress(progress: DataFrame) -> DataFrame:
    """One row per micro-batch: rows, rates, durations and the first two sources.

    Newer Spark versions report the time to find offsets as latestOffset instead of getOffset.
    """
    first, second = F.get("sources", F.lit(0)), F.get("sources", F.lit(1))
    took = {name: F.col(f"durationMs.{name}") for name in PROGRESS_COLUMNS[2:8]}
    took["getOffset"] = F.coalesce("durationMs.getOffset", "durationMs.latestOffset")
    columns = [
        F.col("numInputRows"),
        F.col("processedRowsPerSecond"),
        *took.values(),
        first["numInputRows"],
        first["processedRowsPerSecond"],
        second["numInputRows"],
        second["processedRowsPerSecond"],
    ]
    return progress.select(*[c.alias(name) for c, name in zip(columns, PROGRESS_COLUMNS)])


def progress_table(spark: SparkSession, path: str) -> DataFrame:
    """The flat table of progress reports kept as lines of JSON."""
    return flatten_progress(spark.read.schema(_SCHEMA).json(path))


def observed(df: DataFrame, name: str, first: Column, last: Column) -> DataFrame:
    """``df`` with a count of its rows and the ends of their times taken along by whatever writes it.

    Nothing is read again for it: each micro-batch's figures come with its progress report, see ``observed_reports``.
    """
    metrics = [
        F.count(F.lit(1)).alias("size"),
        F.unix_micros(F.min(first.cast("timestamp"))).alias("first_us"),
        F.unix_micros(F.max(last.cast("timestamp"))).alias("last_us"),
    ]
    return df.observe(name, *metrics)


def observed_reports(spark: SparkSession, path: str, name: str) -> DataFrame:
    """``batch_id``, ``size``, ``latency_ms``, ``first_us``, ``last_us`` of each micro-batch, from kept progress reports.

    A micro-batch that a restart repeated is reported once.
    """
    figures = "STRUCT<size: BIGINT, first_us: BIGINT, last_us: BIGINT>"
    reports = spark.read.schema(f"batchId BIGINT, observedMetrics STRUCT<`{name}`: {figures}>").json(path)
    found = reports.select(F.col("batchId").alias("batch_id"), F.col(f"observedMetrics.`{name}`").alias("of")).where("of is not null")
    latency = F.expr("(of.last_us - of.first_us) div 1000").alias("latency_ms")
    return found.dropDuplicates(["batch_id"]).select("batch_id", "of.size", latency, "of.first_us", "of.last_us")


# Reports that wait to be written together, and the seconds that they wait at most until another one comes.
HELD_REPORTS, HELD_SECONDS = 64, 30


class ReportsIncomplete(UserWarning):
    """A query's end was not told in time: its last reports may be missing."""


class _Reports(StreamingQueryListener):
    """Appends the reports of one query to a folder, so their number is not bounded by what Spark holds.

    Reports are written together, some dozens in one small job; those that wait are lost if the driver is.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.query_id: str | None = None
        self.early: list[tuple[str, str]] = []
        self.held: list[str] = []
        self.written = time.monotonic()
        self.ended: set[str] = set()
        self.changed = threading.Condition(threading.RLock())

    def _hold(self, lines: list[str]) -> None:
        self.held += lines
        if len(self.held) >= HELD_REPORTS or time.monotonic() - self.written >= HELD_SECONDS:
            self.flush()

    def flush(self) -> None:
        with self.changed:
            if self.held:
                rows = self.spark.createDataFrame([(line,) for line in self.held], "value string")
                rows.coalesce(1).write.mode("append").text(self.folder)
                self.held = []
            self.written = time.monotonic()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        # Reports may come before the caller has been told which query they are of.
        with self.changed:
            of, line = str(event.progress.runId), event.progress.json
            if self.query_id is None:
                self.early.append((of, line))
            elif of == self.query_id:
                self._hold([line])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended.add(str(event.runId))
            self.changed.notify_all()

    def follow(self, query: StreamingQuery) -> StreamingQuery:
        with self.changed:
            self.query_id = str(query.runId)
            lines = [line for of, line in self.early if of == self.query_id]
            self.early.clear()
            self._hold(lines)
        return query

    def wait(self, seconds: float = 60) -> None:
        """Until the query's end has been told, which comes after its last report."""
        with self.changed:
            if self.query_id and not self.changed.wait_for(lambda: self.query_id in self.ended, seconds):
                warnings.warn("the end of the query has not been reported", ReportsIncomplete, stacklevel=2)


@contextmanager
def kept_reports(spark: SparkSession, folder: str | None) -> Iterator[Callable[[StreamingQuery], StreamingQuery]]:
    """While open, every progress report of the query handed to it is appended to ``folder`` as a line of JSON."""
    if folder is None:
        yield lambda query: query
        return
    reports = _Reports(spark, folder)
    spark.streams.addListener(reports)
    try:
        yield reports.follow
        reports.wait()
    finally:
        spark.streams.removeListener(reports)
        reports.flush()
