"""Joins of streams. Each gives the rows that the batch join gives on the same input."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflux.functions.columns import Predicate
from conflux.operators.equi import equi_join
from conflux.operators.interval import multiplied, window_counts
from conflux.operators.split import Pairs, Split, key_kinds
from conflux.operators.theta import grid_join, theta_join
from conflux.session import work_folder
from conflux.streaming.keyed import PART, KeyedStore
from conflux.streaming.run import Run, run_batches
from conflux.streaming.store import BATCH, BatchFolder, latest
from conflux.streaming.timed import TimedStore


def stream_join(
    left: DataFrame,
    right: DataFrame,
    how: str = "equi",
    on: Pairs = (),
    predicate: Predicate | None = None,
    split: Split = Split(),
    left_id: Sequence[str] | None = None,
    right_id: Sequence[str] | None = None,
) -> DataFrame:
    """Inner join of two streams: how="equi" on pairs of columns, or how="cross" through a grid.

    A predicate narrows either. Rows of both sides are kept as state for ever: every later row may
    match them. ``split`` divides hot keys (equi) or gives the grid (cross); it must not change as
    long as a checkpoint is in use.
    """
    if how == "equi":
        if not on:
            raise ValueError("an equi join needs columns to join on")
        return equi_join(left, right, on, predicate, split, left_id, right_id)
    if how == "cross":
        return grid_join(left, right, predicate, (split.rows, split.cols), left_id, right_id)
    raise ValueError(f"how is 'equi' or 'cross', not {how!r}")


def stored_join(
    left: DataFrame,
    right: DataFrame,
    join: Callable[[DataFrame, DataFrame], DataFrame],
    name: str,
    run: Run = Run(),
    folder: str | None = None,
    on: Pairs = (),
    parts: int = 64,
    fan: int = 8,
) -> DataFrame:
    """Inner join of two streams that keeps what has come in as files instead of join state.

    Each micro-batch is stored and then joined with all that is stored on the other side, by the batch
    join ``join(left, right)``: broadcasts and splits are chosen anew each time, from the rows there are.

    ``on`` names pairs of columns that ``join`` has equal. Rows are then stored in ``parts`` by key, and of what came in
    earlier, a micro-batch reads the parts that have one of its own keys. Stored batches are merged ``fan`` by ``fan``, see
    ``KeyedStore``. ``parts`` and ``on`` must stay the same as long as the folder is in use.
    """
    spark = left.sparkSession
    folder = folder or work_folder(spark, name)
    left_keys, right_keys = tuple(l for l, _ in on), tuple(r for _, r in on)
    kinds = tuple(key_kinds((left, left_keys), (right, right_keys)))
    lefts = KeyedStore(f"{folder}/left", left.schema, left_keys, kinds, parts, fan)
    rights = KeyedStore(f"{folder}/right", right.schema, right_keys, kinds, parts, fan)
    pairs = BatchFolder(f"{folder}/rows")
    left_schema, right_schema = left.schema, right.schema
    empty = [spark.createDataFrame([], schema) for schema in (left_schema, right_schema)]
    result_schema = join(*empty).schema

    def tagged(df: DataFrame, mine: str, other: str, other_schema) -> DataFrame:
        return df.select(
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(mine),
            F.lit(None).cast(other_schema).alias(other),
        )

    both = tagged(left, "l", "r", right_schema).unionByName(tagged(right, "r", "l", left_schema))

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        before = [store.runs_before(session, batch_id) for store in (lefts, rights)]
        for store, side in ((lefts, "l"), (rights, "r")):
            store.write(batch.where(f"{side} is not null").select(f"{side}.*"), batch_id)
        new_left, new_right = lefts.at(session, batch_id), rights.at(session, batch_id)
        old_left, old_right = lefts.read(session, before[0], new_right), rights.read(session, before[1], new_left)
        new_left, new_right = new_left.drop(PART), new_right.drop(PART)
        found = join(new_left, new_right.unionByName(old_right)).unionByName(join(old_left, new_right))
        pairs.write(found, batch_id)

    run_batches(both, name, each, run, folder=folder)
    return pairs.read(spark, result_schema).drop("batch_id")


class BatchJoins:
    """The equality joins of one micro-batch of a chain, the rows of both sides of each kept in files by key.

    Joins are told apart by their order, which must be the same in every micro-batch. What a join finds in the batch is a
    relation that grows, as its inputs are: the next join keeps it, and only what the batch adds is worked out.
    """

    def __init__(self, folder: str, batch_id: int, parts: int = 64, fan: int = 8):
        self.folder, self.batch_id, self.parts, self.fan = folder, batch_id, parts, fan
        self.joins = 0

    def join(self, left: DataFrame, right: DataFrame, on: Pairs, **options) -> DataFrame:
        """The pairs of ``equi_join`` that came in with this batch: new rows with all, and old rows with new ones."""
        session = left.sparkSession
        path = f"{self.folder}/join-{self.joins}"
        self.joins += 1
        left_keys, right_keys = tuple(l for l, _ in on), tuple(r for _, r in on)
        kinds = tuple(key_kinds((left, left_keys), (right, right_keys)))
        stores = [
            KeyedStore(f"{path}/{side}", df.schema, keys, kinds, self.parts, self.fan)
            for side, df, keys in (("left", left, left_keys), ("right", right, right_keys))
        ]
        before = [store.runs_before(session, self.batch_id) for store in stores]
        for store, df in zip(stores, (left, right), strict=True):
            store.write(df, self.batch_id)
        new_left, new_right = (store.at(session, self.batch_id) for store in stores)
        if not any(before):
            return equi_join(new_left.drop(PART), new_right.drop(PART), on, **options)
        old_left, old_right = stores[0].read(session, before[0], new_right), stores[1].read(session, before[1], new_left)
        new_left, new_right = new_left.drop(PART), new_right.drop(PART)
        found = equi_join(new_left, new_right.unionByName(old_right), on, **options)
        return found.unionByName(equi_join(old_left, new_right, on, **options))


def stored_chain(
    streams: Sequence[DataFrame],
    chain: Callable[..., DataFrame],
    name: str,
    run: Run = Run(),
    folder: str | None = None,
    parts: int = 64,
    fan: int = 8,
) -> DataFrame:
    """A chain of equality joins of streams that keeps its state as files, written and read whole, not row by row.

    ``chain(*tables, join=...)`` puts the joins together from ``join(left, right, on, **options)``; it gets the rows of a
    micro-batch and a join that gives what the batch adds to each. The chain, ``parts`` and the order of the joins must stay
    the same as long as the folder is in use; a repeated micro-batch replaces what it had written.
    """
    spark = streams[0].sparkSession
    folder = folder or work_folder(spark, name)
    rows = BatchFolder(f"{folder}/rows")
    schemas = [df.schema for df in streams]
    result_schema = chain(*[spark.createDataFrame([], schema) for schema in schemas], join=equi_join).schema

    def each(batch: DataFrame, batch_id: int) -> None:
        tables = _apart(batch, len(streams))
        rows.write(chain(*tables, join=BatchJoins(folder, batch_id, parts, fan).join), batch_id)

    run_batches(_together(streams), name, each, run, folder=folder)
    return rows.read(spark, result_schema).drop(BATCH)


def _together(streams: Sequence[DataFrame]) -> DataFrame:
    """Streams as one, of which each row is a struct in the column of its stream."""
    schemas = [df.schema for df in streams]
    names = [f"s{i}" for i in range(len(streams))]

    def tagged(i: int, df: DataFrame) -> DataFrame:
        own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        return df.select(*[own.alias(n) if n == names[i] else F.lit(None).cast(schemas[j]).alias(n) for j, n in enumerate(names)])

    return reduce(DataFrame.unionByName, [tagged(i, df) for i, df in enumerate(streams)])


def _apart(batch: DataFrame, n: int) -> list[DataFrame]:
    """The rows of each of ``n`` streams in a micro-batch of ``_together``."""
    return [batch.where(f"s{i} is not null").select(f"s{i}.*") for i in range(n)]


def stored_interval_join(
    streams: Sequence[tuple[DataFrame, str]],
    join: Callable[..., DataFrame],
    within: timedelta,
    lateness: timedelta,
    name: str,
    run: Run = Run(),
    folder: str | None = None,
    lists: Sequence[str] = (),
) -> DataFrame:
    """A join of streams (with their time columns) that lie within an interval, the rows that are still needed kept in files.

    ``join(*tables)`` is the batch join: ``interval_join``, or ``interval_chain`` with all others within the interval of the
    first. A micro-batch adds the results that have a row of its own, each once: new rows of one table, rows from before of
    the tables ahead of it, and all rows of those after it. Only rows of the streams are kept, no results of a join that
    another one follows, and only as long as a row that is not late may be near them: ``lateness`` is how
    far, in event time, rows may come behind the stream that is least far. Rows that are later may find nothing.

    ``lists`` names columns of ``join``'s result that are lists, as those of ``interval_chain`` with ``lists``: micro-batches
    write them as they are found, and their combinations, which may be many times more, are rows of what is returned.
    """
    spark = streams[0][0].sparkSession
    folder = folder or work_folder(spark, name)
    together = _together([df for df, _ in streams])
    store = TimedStore(f"{folder}/kept", together.schema, {f"s{i}": ts for i, (_, ts) in enumerate(streams)})
    rows = BatchFolder(f"{folder}/rows")
    result_schema = join(*[spark.createDataFrame([], df.schema) for df, _ in streams]).schema
    # Rows of two tables that are both near a row of the first are up to twice the interval apart.
    reach = lateness + within * min(2, len(streams) - 1)

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        store.write(batch, batch_id)
        new = _apart(store.new(session, batch_id), len(streams))
        if batch_id == 0:
            rows.write(join(*new), batch_id)
            return
        store.carry(session, batch_id, reach)
        old = _apart(store.old(session, batch_id), len(streams))
        every = [n.unionByName(o) for n, o in zip(new, old, strict=True)]
        found = [join(*old[:i], new[i], *every[i + 1 :]) for i in range(len(streams))]
        rows.write(reduce(DataFrame.unionByName, found), batch_id)

    run_batches(together, name, each, run, folder=folder)
    return multiplied(rows.read(spark, result_schema).drop(BATCH), lists)


def stored_theta_join(
    left: DataFrame,
    right: DataFrame,
    predicate: Predicate,
    name: str,
    run: Run = Run(),
    side: str | None = "auto",
    folder: str | None = None,
) -> DataFrame:
    """``stored_join`` on a predicate."""
    return stored_join(left, right, lambda l, r: theta_join(l, r, predicate, side), name, run, folder)


def stream_window_counts(
    df: DataFrame,
    ts: str,
    by: Sequence[str],
    length: str,
    slide: str,
    lateness: str,
    name: str,
    run: Run = Run(),
    folder: str | None = None,
) -> DataFrame:
    """Rows per sliding window of a stream, the windows still open included.

    Each micro-batch writes the windows it changed. A window's state is dropped once the stream is
    ``lateness`` past its end; rows that come later still are not counted.
    """
    spark = df.sparkSession
    folder = folder or work_folder(spark, name)
    counts = window_counts(df.withWatermark(ts, lateness), ts, by, length, slide)
    updates = BatchFolder(f"{folder}/rows")
    run_batches(counts, name, updates.write, run, mode="update", folder=folder)
    return latest(updates.read(spark, counts.schema), ["window_start", *by])
