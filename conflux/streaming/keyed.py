"""A relation that grows by micro-batches, kept in files by key: few runs, of which a reader takes the parts it needs.

Each micro-batch is a run: a Parquet folder with one partition for each range of key hashes. Runs of one level are merged into a
run of the next level, sorted by key, as soon as there are ``fan`` of them, so there are ``fan`` times the logarithm of the
batches at most and each row is rewritten once for each level. A manifest, one line in one file, names the live
runs that stand for all batches before a given one. It is there or not there, and what it leaves out is not read: a run
whose writing or merging was cut off is written again by the batch that is repeated.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from conflux.operators.split import key_hash, with_keys
from conflux.session import remove

PART = "__part"
# Manifests that are kept: the newest, the one before it, in case a batch is repeated, and some more.
_SLOTS = 8


@dataclass(frozen=True, order=True)
class KeyedRun:
    """The rows of the batches from ``first`` to ``last``."""

    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"{self.level}-{self.first}-{self.last}"


def merges(runs: Sequence[KeyedRun], fan: int) -> list[tuple[KeyedRun, list[KeyedRun]]]:
    """What is to be merged, in order: each new run with the ``fan`` or more neighbouring runs of one level it replaces."""
    runs, out = sorted(runs), []
    while True:
        level = next((n for n in sorted({r.level for r in runs}) if sum(r.level == n for r in runs) >= fan), None)
        if level is None:
            return out
        old = [r for r in runs if r.level == level]
        new = KeyedRun(old[0].first, old[-1].last, level + 1)
        out.append((new, old))
        runs = sorted([r for r in runs if r.level != level] + [new])


@dataclass(frozen=True)
class KeyedStore:
    """``keys`` are compared as ``kinds`` (see ``key_kinds``); rows with a null key match nothing and aren't kept.

    Without keys there is one part, and readers take all of it. ``parts`` must stay the same for the life of a folder.
    """

    path: str
    schema: StructType
    keys: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    parts: int = 64
    fan: int = 8

    def _folder(self, run: KeyedRun) -> str:
        return f"{self.path}/runs/{run.name}"

    def with_part(self, df: DataFrame) -> DataFrame:
        if not self.keys:
            return df.withColumn(PART, F.lit(0))
        hashed = key_hash(df, self.keys, self.kinds)
        return with_keys(df, self.keys).withColumn(PART, F.pmod(hashed, F.lit(self.parts)).cast("int"))

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Keep a batch; a repeated one replaces itself."""
        rows = self.with_part(df)
        if self.keys:
            # Rows of one part meet in one file, as long as they are few.
            rows = rows.hint("rebalance", PART)
        rows.write.mode("overwrite").partitionBy(PART).parquet(self._folder(KeyedRun(batch_id, batch_id, 0)))

    def _read(self, spark: SparkSession, runs: Sequence[KeyedRun]) -> DataFrame:
        """The rows of runs, with their part; a folder without rows has no files to tell its columns by."""
        numbered = StructType([*self.schema.fields]).add(PART, IntegerType())
        found = None
        for run in runs:
            try:
                rows = spark.read.schema(numbered).option("basePath", self._folder(run)).parquet(self._folder(run))
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                continue
            found = rows if found is None else found.unionByName(rows)
        return spark.createDataFrame([], numbered) if found is None else found

    def at(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The rows of one batch, with their part."""
        return self._read(spark, [KeyedRun(batch_id, batch_id, 0)])

    def _manifest(self, spark: SparkSession, batch_id: int) -> list[KeyedRun] | None:
        try:
            lines = spark.read.text(f"{self.path}/manifests").select("value").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        found = [m for m in (json.loads(r["value"]) for r in lines) if m["before"] == batch_id]
        return [KeyedRun(**r) for r in found[0]["runs"]] if found else None

    def runs_before(self, spark: SparkSession, batch_id: int) -> list[KeyedRun]:
        """The live runs of all batches before one. To be called before ``write`` of that batch.

        The first call for a batch merges runs where there are enough of them, and removes those that were merged:
        whoever repeats the batch finds the new manifest.
        """
        runs = self._manifest(spark, batch_id)
        if runs is not None or batch_id == 0:
            return runs or []
        before = self._manifest(spark, batch_id - 1)
        if before is None and batch_id > 1:
            raise RuntimeError(f"{self.path} has no manifest of batch {batch_id - 1}")
        runs = [*(before or []), KeyedRun(batch_id - 1, batch_id - 1, 0)]
        gone = []
        for new, old in merges(runs, self.fan):
            rows = self._read(spark, old).hint("rebalance", PART)
            rows.sortWithinPartitions(PART, *self.keys).write.mode("overwrite").partitionBy(PART).parquet(self._folder(new))
            runs = sorted([r for r in runs if r not in old] + [new])
            gone += old
        line = json.dumps({"before": batch_id, "runs": [asdict(r) for r in runs]})
        slot = spark.createDataFrame([(line,)], "value string").coalesce(1)
        slot.write.mode("overwrite").text(f"{self.path}/manifests/slot={batch_id % _SLOTS}")
        for run in gone:
            remove(spark, self._folder(run))
        return runs

    def read(self, spark: SparkSession, runs: Sequence[KeyedRun], met: DataFrame | None = None) -> DataFrame:
        """The rows of runs; with ``met``, rows of another store's batch, only of parts that have rows there."""
        rows = self._read(spark, runs)
        if met is not None and self.keys:
            # As many as there are parts, at most.
            parts = [r[PART] for r in met.select(PART).distinct().collect()]
            rows = rows.where(F.col(PART).isin(parts))
        return rows.drop(PART)
