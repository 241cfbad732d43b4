"""Column expressions shared by the joins, the sources and the sinks."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Side:
    """The columns of one join input, as handed to a predicate: ``side.key`` or ``side["key"]``.

    Columns are looked up by name only, so a predicate keeps its meaning after the join has
    added columns of its own to either input.
    """

    def __init__(self, columns: Sequence[str]):
        self._columns = frozenset(columns)
        self._asked = False

    def __getitem__(self, name: str) -> Column:
        self._asked = True
        if name not in self._columns:
            raise AttributeError(f"no column {name!r} here; there are {sorted(self._columns)}")
        return F.col(f"`{name}`")

    def __getattr__(self, name: str) -> Column:
        return self[name]


Predicate = Callable[[Side, Side], Column]


def require_distinct_names(left: DataFrame, right: DataFrame) -> None:
    shared = sorted(set(left.columns) & set(right.columns))
    if shared:
        raise ValueError(f"both inputs have columns {shared}; rename one side, e.g. with prefixed()")


def condition_of(left: DataFrame, right: DataFrame, predicate: Predicate) -> Column:
    require_distinct_names(left, right)
    return predicate(Side(left.columns), Side(right.columns))


def sided(
    left: DataFrame, right: DataFrame, predicates: Predicate | Sequence[Predicate] | None
) -> tuple[DataFrame, DataFrame, Column | None]:
    """The inputs of an inner join, filtered by the predicates that ask for columns of one side only, and all others as one condition."""
    require_distinct_names(left, right)
    both = None
    for predicate in [predicates] if callable(predicates) else predicates or []:
        l, r = Side(left.columns), Side(right.columns)
        condition = predicate(l, r)
        if l._asked and not r._asked:
            left = left.where(condition)
        elif r._asked and not l._asked:
            right = right.where(condition)
        else:
            both = condition if both is None else both & condition
    return left, right, both


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Put ``prefix`` before every column name, so that a relation can be joined with itself."""
    return df.select([F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def python_predicate(
    fn: Callable[..., bool], left_columns: Sequence[str], right_columns: Sequence[str], vectorized: bool = True
) -> Predicate:
    """Make a join predicate out of a Python function over the named columns' values.

    The function is called on whole Series, Arrow batches of candidate pairs; without ``vectorized`` once per pair,
    which is slow. Catalyst cannot look inside it, so prefer Column predicates.
    """

    def check(*values: pd.Series) -> pd.Series:
        if vectorized:
            return fn(*values)
        return pd.Series([bool(fn(*row)) for row in zip(*values)], dtype=bool)

    check.__annotations__ = {"values": pd.Series, "return": pd.Series}
    udf = F.pandas_udf(check, "boolean")
    return _opaque(lambda l, r: udf(*[l[c] for c in left_columns], *[r[c] for c in right_columns]))


def arrow_predicate(fn: Callable[..., pa.Array], left_columns: Sequence[str], right_columns: Sequence[str]) -> Predicate:
    """Make a join predicate out of a function of Arrow arrays, one for each named column, that gives an array of booleans.

    Candidate pairs come in Arrow batches and stay in that form. Nulls in the result drop the pair. Catalyst can't look
    inside, so a join needs an equality or a grid beside it (see ``is_opaque``).
    """

    def check(*values: pa.Array) -> pa.Array:
        return fn(*values)

    check.__annotations__ = {"values": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(check, "boolean")
    return _opaque(lambda l, r: udf(*[l[c] for c in left_columns], *[r[c] for c in right_columns]))


def _opaque(predicate: Predicate) -> Predicate:
    predicate.opaque = True
    return predicate


def is_opaque(predicate: Predicate | None) -> bool:
    """Whether the predicate is a Python function, for which Spark would build every pair of rows in one place."""
    return getattr(predicate, "opaque", False)


def checked_cast(text: Column, to: str) -> Column:
    """``text`` as ``to``; what is no such value, null included, fails the query whatever the session's ANSI mode."""
    value = text.try_cast(to)
    shown = F.coalesce(text.cast("string"), F.lit("null"))
    return F.when(value.isNull(), F.raise_error(F.concat(shown, F.lit(f" is no {to}"))).cast(to)).otherwise(value)


def split_field(text: Column, position: int, to: str = "int", sep: str = "|") -> Column:
    """Field ``position`` of a delimited line, cast to ``to``; bad numbers and short lines fail the query."""
    return checked_cast(F.get(F.split(text, re.escape(sep)), F.lit(position)), to)


def stamped(df: DataFrame, name: str = "arrival_ts") -> DataFrame:
    """Add the time at which the rows came in: one instant per batch query or micro-batch."""
    return df.withColumn(name, F.current_timestamp())


def earliest(*stamps: Column) -> Column:
    return F.least(*stamps)


def csv_line(*columns: Column) -> Column:
    """The values joined by commas."""
    return F.concat_ws(",", *[c.cast("string") for c in columns])


def row_message(df: DataFrame) -> DataFrame:
    """Turn each row into a message: its text as ``key``, its JSON as ``value``."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    return df.select(csv_line(*columns).alias("key"), F.to_json(F.struct(*columns)).alias("value"))
