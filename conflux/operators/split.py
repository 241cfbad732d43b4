"""Splitting join work so that no task has to hold all rows of one key.

A join key may be given a grid of ``rows x cols`` cells. Every left row of that key is dealt to one
grid row and copied to each column; every right row is dealt to one column and copied to each row.
A left row and a right row then meet in exactly one cell, whatever the grid, so the result does not
depend on it (1-Bucket-Theta, Okcan & Riedewald, SIGMOD 2011, applied per key). Ordinary keys have
one cell, i.e. no copies. A theta join is the case in which all rows share one key.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conflux.functions.columns import require_distinct_names

# Sketches of the most frequent keys are merged in this many groups of map tasks, then into one.
SKETCH_GROUPS = 64
MIN_ROWS_PER_CELL = 1_000_000

# Candidate pairs one cell is meant to check: in a grid over all rows, and in the grid of one key,
# which has but one cell as long as it is below that.
PAIRS_PER_CELL = 10_000_000
PAIRS_PER_KEY_CELL = 100_000_000

# Bytes of rows that one partition of a stream's state is meant to hold, and the least that is worth one of its own.
STATE_BYTES, LEAST_STATE_BYTES = 1 << 30, 4 << 20

ROW, COL = "__cell_row", "__cell_col"

Pairs = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class Split:
    """Grid for all keys (``rows x cols``) and larger grids for the hashes of some of them."""

    rows: int = 1
    cols: int = 1
    heavy: tuple[tuple[int, int, int], ...] = ()

    def __post_init__(self):
        if min([self.rows, self.cols, *(n for h in self.heavy for n in h[1:])]) < 1:
            raise ValueError("a grid needs at least one row and one column")

    @property
    def whole(self) -> bool:
        return (self.rows, self.cols) == (1, 1) and not self.heavy

    def within(self, other: Split) -> Split:
        """The split whose grids have the rows and columns of the larger one of the two, key by key."""
        rows, cols = max(self.rows, other.rows), max(self.cols, other.cols)
        heavy: dict[int, tuple[int, int]] = {}
        for key, r, c in (*self.heavy, *other.heavy):
            seen = heavy.get(key, (rows, cols))
            heavy[key] = max(seen[0], r), max(seen[1], c)
        return Split(rows, cols, tuple((key, *grid) for key, grid in sorted(heavy.items()) if grid != (rows, cols)))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes; negative when broadcasting is switched off."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    return int(conf.autoBroadcastJoinThreshold())


def _counted(df: DataFrame) -> DataFrame:
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    width = F.lit(8 * (1 + len(df.columns))).cast("bigint")
    for f in df.schema.fields:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(column), F.lit(0))
        elif not isinstance(f.dataType, fixed):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"))


def measured(*inputs: DataFrame) -> list[tuple[int, int]]:
    """Rows and bytes of each input, counted in one job.

    A fixed-width value counts for eight bytes, any other for its length.
    """
    counts = [_counted(df).withColumn("i", F.lit(i)) for i, df in enumerate(inputs)]
    found = {row["i"]: (row["n"], row["bytes"]) for row in reduce(DataFrame.unionAll, counts).collect()}
    return [found[i] for i in range(len(inputs))]


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    limit = broadcast_limit(df) if limit is None else limit
    return 0 <= plan_bytes(df) <= limit


def parallelism(df: DataFrame) -> int:
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def top_keys(cores: int) -> int:
    """How many of the most frequent keys are looked up for a grid of their own.

    A key gets one if it has more rows than half a core's share, which is true of 2 * cores keys of an input at most.
    """
    return min(max(1024, 4 * cores), 100_000)


def sketch_items(cores: int) -> int:
    """Candidates a sketch keeps: its counts are then off by a small part of a core's share at most."""
    return min(8 * top_keys(cores), 1_000_000)


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def _kind(types: Sequence[T.DataType]) -> str:
    """What columns of these types are compared as; "any" where their equality can't be put in terms of one type."""

    def all_are(*kinds) -> bool:
        return all(isinstance(t, kinds) for t in types)

    if all_are(*_INTEGERS):
        return "bigint"
    if all_are(T.NumericType, T.StringType) and not all_are(T.StringType):
        # Equal numbers of any types are equal as doubles, and doubles that differ are not.
        return "same" if all(t == types[0] for t in types) and not all_are(T.FractionalType) else "double"
    if all(t == types[0] for t in types) and not _has_map(types[0]):
        return "same"
    if all_are(*_TIMES, T.StringType):
        return "timestamp"
    if all_are(T.BinaryType, T.StringType):
        return "binary"
    return "any"


def _has_map(dtype: T.DataType) -> bool:
    return not is_orderable(dtype)


def _normal(column: Column, kind: str) -> Column:
    """A form of the key whose hash is the same on both sides whenever the keys are equal."""
    if kind == "any":
        return F.lit(0)
    if kind == "double":
        value = column.try_cast("double")
        return F.when(value == 0, F.lit(0.0)).otherwise(value)
    return column if kind == "same" else column.try_cast(kind)


# Bits for each key of a filter, and the most bits there are: 2 million words of 64, some 32 MB.
FILTER_BITS, MOST_FILTER_BITS = 8, 1 << 27


def key_filter(df: DataFrame, key: str, keys: DataFrame, other: str, expected: int) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be among the column ``other`` of ``keys``: all that are, and few more.

    A bitmap of the keys' hashes is put together in the tasks and sent to where ``df`` is read, so that rows without a partner
    are not shuffled. ``expected`` bounds the number of keys; with over a key for each bit there would be nothing to gain, and
    ``df`` comes back as it is.
    """
    if expected > MOST_FILTER_BITS:
        return df
    bits = min(MOST_FILTER_BITS, max(1 << 16, 1 << (FILTER_BITS * max(1, expected) - 1).bit_length()))
    kinds = key_kinds((df, [key]), (keys, [other]))
    place = F.pmod(key_hash(keys, [other], kinds), F.lit(bits))
    words = (
        with_keys(keys, [other])
        .select(F.shiftright(place, 6).alias("__at"), F.expr("1L").alias("__one"), (place % 64).cast("int").alias("__bit"))
        .groupBy("__at")
        .agg(F.bit_or(F.call_function("shiftleft", F.col("__one"), F.col("__bit"))).alias("__word"))
    )
    own = F.pmod(key_hash(df, [key], kinds), F.lit(bits))
    set_ = F.call_function("shiftright", F.col("__word"), (own % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(words), (F.shiftright(own, 6) == F.col("__at")) & set_, "left_semi")


def state_partitions(*inputs: DataFrame) -> int:
    """Partitions for the state of joins of streams that hold these tables, by the bytes of their rows.

    Each gets about ``STATE_BYTES``; small inputs are spread over the cores as far as it is worth a store on each. Tables whose
    size the optimizer puts under that of one core's state aren't counted. Spark keeps the number with the checkpoint: a
    restart goes on with the one it began with.
    """
    cores = parallelism(inputs[0])
    total = sum(plan_bytes(df) for df in inputs)
    if total > STATE_BYTES:
        total = sum(size for _, size in measured(*inputs))
    return max(-(-total // STATE_BYTES), min(cores, -(-total // LEAST_STATE_BYTES)), 1)


def key_kinds(*inputs: tuple[DataFrame, Sequence[str]]) -> list[str]:
    """For each key position, the kind its columns in all the inputs are compared as."""
    return [_kind([df.schema[k].dataType for (df, _), k in zip(inputs, ks, strict=True)]) for ks in zip(*[k for _, k in inputs], strict=True)]


def key_hash(df: DataFrame, keys: Sequence[str], kinds: Sequence[str] | None = None) -> Column:
    """A hash of the keys that is the same in every input whose keys are compared as the same ``kinds``."""
    kinds = key_kinds((df, keys)) if kinds is None else kinds
    return F.xxhash64(*[_normal(F.col(f"`{k}`"), kind) for k, kind in zip(keys, kinds, strict=True)])


def _key_hashes(left: DataFrame, right: DataFrame, on: Pairs) -> tuple[Column, Column]:
    ls, rs = [l for l, _ in on], [r for _, r in on]
    kinds = key_kinds((left, ls), (right, rs))
    return key_hash(left, ls, kinds), key_hash(right, rs, kinds)


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that can match: those without a null key."""
    for k in keys:
        df = df.where(F.col(f"`{k}`").isNotNull())
    return df


def grid_shape(n_left: float, n_right: float, cells: int) -> tuple[int, int]:
    """Rows and columns of a grid of about ``cells`` cells that copies as few rows as possible.

    A grid copies ``cols * n_left + rows * n_right`` rows; for a given number of cells that is least
    when rows and columns are in the proportion of the inputs.
    """
    n_left, n_right = math.ceil(n_left), math.ceil(n_right)
    if min(n_left, n_right) == 0:
        return 1, 1
    rows = round(math.sqrt(cells * n_left / n_right))
    rows = min(max(1, rows), cells, n_left)
    cols = min(max(1, math.ceil(cells / rows)), n_right)
    if cols == n_right:
        rows = min(max(1, math.ceil(cells / cols)), n_left)
    return rows, cols


def cells_for(n_left: int, n_right: int, cores: int) -> int:
    """Cells for a grid over all rows: enough to keep every core busy and to let even work fall out of many
    small cells, whose rows stay in the processor's cache, as far as there are pairs to fill them."""
    pairs = n_left * n_right
    return max(cores, min(16 * cores, pairs // 100_000), math.ceil(pairs / PAIRS_PER_CELL))


@dataclass(frozen=True)
class Profile:
    """How the rows of an input are spread over its keys: their number, the keys' number, the top keys."""

    rows: float
    keys: int
    top: dict[int, float]

    @property
    def mean(self) -> float:
        return self.rows / max(1, self.keys)

    def count(self, key: int) -> float:
        return self.top.get(key, self.mean)

    def paired(self, other: Profile) -> Profile:
        """The profile that the join of the two inputs has if their keys are the same."""
        top = {key: self.count(key) * other.count(key) for key in self.top.keys() | other.top.keys()}
        keys = max(self.keys, other.keys)
        return Profile(self.mean * other.mean * keys, keys, top)


def _sketched(df: DataFrame, keys: Sequence[str], kinds: Sequence[str], number: int) -> DataFrame:
    """One row: row count, number of keys and sketch of the most frequent keys, summed up in every map task, then in
    ``SKETCH_GROUPS`` groups of them, then altogether."""
    cores = parallelism(df)
    groups = (
        with_keys(df, keys)
        .select(key_hash(df, keys, kinds).alias("h"))
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"))
        .agg(
            F.count("h").alias("n"),
            F.hll_sketch_agg("h").alias("keys"),
            F.expr(f"approx_top_k_accumulate(h, {sketch_items(cores)})").alias("top"),
        )
    )
    # By a group for all rows, as sketches of no input at all can't be merged.
    return groups.groupBy(F.lit(number).alias("i")).agg(
        F.sum("n").alias("n"),
        F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("keys"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(top), {top_keys(cores)})").alias("top"),
    )


def profiles(*inputs: tuple[DataFrame, Sequence[str]], kinds: Sequence[Sequence[str]] | None = None) -> list[Profile]:
    """Profile inputs by the given key columns, in one job; rows with a null key are left out, and nothing is shuffled by key.

    Keys are compared as the same kinds in all inputs, or in each as ``kinds`` says.
    """
    kinds = [key_kinds(*inputs)] * len(inputs) if kinds is None else kinds
    parts = [_sketched(df, keys, kind, i) for i, ((df, keys), kind) in enumerate(zip(inputs, kinds, strict=True))]
    found = {row["i"]: row for row in reduce(DataFrame.unionAll, parts).collect()}
    return [
        Profile(row["n"], row["keys"], {t["item"]: t["count"] for t in row["top"] or []}) if row else Profile(0, 0, {})
        for row in (found.get(i) for i in range(len(inputs)))
    ]


def split_for(
    left: Profile, right: Profile, cores: int, rows_per_cell: int | None = None, pairs_per_cell: int = PAIRS_PER_KEY_CELL
) -> Split:
    """A split that gives no cell much more than ``rows_per_cell`` rows of one key of either side, nor
    many more than ``pairs_per_cell`` pairs of them to check.

    By default, the rows are the share of a core, but not less than MIN_ROWS_PER_CELL.
    """
    if rows_per_cell is None:
        rows_per_cell = max(MIN_ROWS_PER_CELL, int(left.rows + right.rows) // (2 * cores))

    def grid_of(n_left: float, n_right: float) -> tuple[int, int]:
        rows, cols = (max(1, math.ceil(n / rows_per_cell)) for n in (n_left, n_right))
        cells = math.ceil(n_left * n_right / pairs_per_cell)
        if cells <= rows * cols:
            return rows, cols
        shape = grid_shape(n_left, n_right, cells)
        return max(rows, shape[0]), max(cols, shape[1])

    base = grid_of(left.mean, right.mean)
    heavy = []
    for key in sorted(left.top.keys() | right.top.keys()):
        own = grid_of(left.count(key), right.count(key))
        grid = max(base[0], own[0]), max(base[1], own[1])
        if grid != base:
            heavy.append((key, *grid))
    return Split(*base, tuple(heavy))


def measure(left: DataFrame, right: DataFrame, on: Pairs, rows_per_cell: int | None = None) -> Split:
    """Choose a split from one counting pass over the keys of each side."""
    found = profiles((left, [l for l, _ in on]), (right, [r for _, r in on]))
    return split_for(*found, parallelism(left), rows_per_cell)


def measure_all(joins: Sequence[tuple[DataFrame, DataFrame, Pairs]]) -> list[Split]:
    """Splits of several joins of tables at rest from one counting job; none where Catalyst can broadcast a side."""
    large = [i for i, (left, right, _) in enumerate(joins) if not fits_broadcast(left) and not fits_broadcast(right)]
    inputs, kinds = [], []
    for left, right, on in (joins[i] for i in large):
        both = [(left, [l for l, _ in on]), (right, [r for _, r in on])]
        inputs += both
        kinds += [key_kinds(*both)] * 2
    found = profiles(*inputs, kinds=kinds) if inputs else []
    splits = [Split()] * len(joins)
    for k, i in enumerate(large):
        splits[i] = split_for(found[2 * k], found[2 * k + 1], parallelism(joins[i][0]))
    return splits


def is_orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(is_orderable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return is_orderable(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def row_number_hash(df: DataFrame, row_id: Sequence[str] | None, streaming: bool = False) -> tuple[DataFrame, Column]:
    """A number per row to deal it by, which comes out the same if a task is run again.

    ``row_id`` names columns that tell rows apart. Without it, a batch input is sorted within its
    partitions (no shuffle) and numbered there: equal rows get different numbers, so copies of one row
    are spread too, and a rerun can at most swap rows that are equal. In a streaming query, where numbering is
    not available, the whole row is hashed; give ``row_id`` if many rows may be equal.
    """
    if row_id:
        return df, F.xxhash64(*[F.col(f"`{c}`") for c in row_id])
    # What has no order is put in order by its text.
    columns = [F.col(f"`{f.name}`") if is_orderable(f.dataType) else _text(f) for f in df.schema.fields]
    if streaming or df.isStreaming:
        return df, F.xxhash64(*columns)
    ordered = df.sortWithinPartitions(F.xxhash64(*columns), *columns)
    numbered = ordered.withColumn("__row", F.xxhash64(F.monotonically_increasing_id()))
    return numbered, F.col("__row")


def _text(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    return column.cast("string") if isinstance(field.dataType, T.VariantType) else F.to_json(F.struct(column))


def _grids(df: DataFrame, split: Split) -> DataFrame:
    """One row for each hot key, of which there are ``top_keys`` for each side at most."""
    return F.broadcast(df.sparkSession.createDataFrame(list(split.heavy), "__hot long, __hot_rows int, __hot_cols int"))


def _dealt(
    df: DataFrame,
    split: Split,
    hashed: Column | None,
    own: str,
    other: str,
    row_id: Sequence[str] | None,
    streaming: bool = False,
    hot_only: bool = False,
) -> DataFrame:
    """``df`` with the cells its rows go to; with ``hot_only``, only the rows of hot keys, found before any is numbered."""
    kept = df.columns
    if hot_only:
        df = df.join(_grids(df, split), hashed == F.col("__hot"), "left_semi")
    pieces = [split.rows, *(h[1] for h in split.heavy)] if own == ROW else [split.cols, *(h[2] for h in split.heavy)]
    if max(pieces) > 1:
        df, number = row_number_hash(df, row_id, streaming)
    else:
        # Always 0, but not a literal: a folded constant would take the cell out of the join keys.
        number = F.pmod(F.xxhash64(F.col(f"`{kept[0]}`")), F.lit(1))
    rows, cols = F.lit(split.rows), F.lit(split.cols)
    if split.heavy:
        df = df.withColumn("__hash", hashed).join(_grids(df, split), F.col("__hash") == F.col("__hot"), "left")
        rows, cols = F.coalesce("__hot_rows", rows), F.coalesce("__hot_cols", cols)
    here, there = (rows, cols) if own == ROW else (cols, rows)
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        F.pmod(number, here.cast("bigint")).cast("int").alias(own),
        F.explode(F.sequence(F.lit(0), there - 1)).alias(other),
    )


def meet(
    left: DataFrame,
    right: DataFrame,
    on: Pairs,
    condition: Column | None,
    split: Split,
    left_id: Sequence[str] | None = None,
    right_id: Sequence[str] | None = None,
    apart: bool = False,
    cells: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Inner join on the pairs of columns ``on`` and ``condition``, the work divided by ``split``.

    ``tasks`` is for tables at rest whose join gives far more rows than it reads: it is done in so many tasks, each with its keys
    or cells, however few bytes come in and also if a side is broadcast. With ``cells``, the result has the cells in which its
    rows were found, if there are grids: the columns ``ROW`` and ``COL``.

    With ``apart``, where only some keys of tables at rest have a grid, all other rows are joined plainly: conditions reach
    their scans, nothing is numbered or copied. The rows of hot keys are picked out by a broadcast list of these keys, dealt
    over their grids, joined, and added. Both inputs are worked out twice for it, so it is for tables, not for joins of joins.
    """
    require_distinct_names(left, right)
    streaming = left.isStreaming or right.isStreaming
    if cells and not split.whole:
        return _met(left, right, on, condition, split, left_id, right_id, False, [ROW, COL], tasks)
    if apart and split.heavy and (split.rows, split.cols) == (1, 1) and not streaming:
        left, right = with_keys(left, [l for l, _ in on]), with_keys(right, [r for _, r in on])
        hashes = _key_hashes(left, right, on)
        cold = [df.join(_grids(df, split), h == F.col("__hot"), "left_anti") for df, h in zip((left, right), hashes, strict=True)]
        rest = _met(*cold, on, condition, Split(), left_id, right_id, False)
        return rest.unionAll(_met(left, right, on, condition, split, left_id, right_id, True))
    return _met(left, right, on, condition, split, left_id, right_id, False, tasks=tasks)


def in_all_cells(df: DataFrame, keys: Sequence[str], split: Split, row: str, col: str) -> DataFrame:
    """``df`` with each row copied to all cells of its key, whose numbers are the columns ``row`` and ``col``.

    It meets what ``meet`` found with the same split, in the cells where it was found.
    """
    df = with_keys(df, keys)
    kept = df.columns
    rows, cols = F.lit(split.rows), F.lit(split.cols)
    if split.heavy:
        df = df.withColumn("__hash", key_hash(df, keys)).join(_grids(df, split), F.col("__hash") == F.col("__hot"), "left")
        rows, cols = F.coalesce("__hot_rows", rows), F.coalesce("__hot_cols", cols)
    cell = F.explode(F.sequence(F.lit(0), rows * cols - 1)).alias("__cell")
    copied = df.select(*[F.col(f"`{c}`") for c in kept], cols.alias("__cols"), cell)
    at = F.floor(F.col("__cell") / F.col("__cols")).cast("int")
    return copied.select(*[F.col(f"`{c}`") for c in kept], at.alias(row), F.pmod("__cell", "__cols").cast("int").alias(col))


def _met(left, right, on, condition, split, left_id, right_id, hot_only, cells=(), tasks=None) -> DataFrame:
    output = [*left.columns, *right.columns, *cells]
    equal = [F.col(f"`{l}`") == F.col(f"`{r}`") for l, r in on]
    streaming = left.isStreaming or right.isStreaming
    if not split.whole or (streaming and not on):
        left_hash, right_hash = _key_hashes(left, right, on) if split.heavy else (None, None)
        # Numbering keeps Catalyst from moving this below by itself.
        left, right = with_keys(left, [l for l, _ in on]), with_keys(right, [r for _, r in on])
        left = _dealt(left, split, left_hash, ROW, COL, left_id, streaming, hot_only)
        right = _dealt(right, split, right_hash, COL, ROW, right_id, streaming, hot_only)
        right = right.withColumnsRenamed({ROW: ROW + "_r", COL: COL + "_r"})
        equal += [F.col(ROW) == F.col(ROW + "_r"), F.col(COL) == F.col(COL + "_r")]
    if tasks and not streaming:
        # Both sides, as either may be the one that is broadcast.
        left, right = (
            df.repartition(tasks, *[F.col(f"`{c}`") for c in (*keys, *cell) if c in df.columns])
            for df, keys, cell in (
                (left, [l for l, _ in on], (ROW, COL)),
                (right, [r for _, r in on], (ROW + "_r", COL + "_r")),
            )
        )
    if equal:
        matched = equal[0]
        for e in equal[1:]:
            matched = matched & e
        joined = left.join(right, matched)
    else:
        joined = left.crossJoin(right)
    if condition is not None:
        joined = joined.where(condition)
    return joined.select(*[F.col(f"`{c}`") for c in output])
