"""Equality joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from conflux.functions.columns import Predicate, sided
from conflux.operators.split import Pairs, Split, fits_broadcast, measure, meet


def choose_split(left: DataFrame, right: DataFrame, on: Pairs, split: Split | str | None) -> Split:
    """Resolve ``split``: a given grid, None for no splitting, or "auto".

    "auto" leaves the join alone when a side is small enough for Catalyst to broadcast it (there is
    no shuffle to be skewed then) and otherwise measures the keys.
    """
    if isinstance(split, Split):
        return split
    if split is None:
        return Split()
    if split != "auto":
        raise ValueError(f"split is a Split, None or 'auto', not {split!r}")
    if left.isStreaming or right.isStreaming:
        raise ValueError("keys of a stream cannot be measured; pass a Split")
    if fits_broadcast(left) or fits_broadcast(right):
        return Split()
    return measure(left, right, on)


def equi_join(
    left: DataFrame,
    right: DataFrame,
    on: Pairs,
    residual: Predicate | Sequence[Predicate] | None = None,
    split: Split | str | None = "auto",
    left_id: Sequence[str] | None = None,
    right_id: Sequence[str] | None = None,
    apart: bool = True,
) -> DataFrame:
    """All pairs with equal keys for which ``residual`` holds, duplicates kept; columns are left, then right.

    ``on`` lists pairs of column names. Of several residual predicates, those that look at one side only filter it before
    anything else, hot keys included. Works on batch and streaming inputs; for streams give a fixed Split (or None).

    Batch inputs are read twice if some keys are hot, once for these and once for all others; ``apart=False`` reads them once,
    and is for inputs that are costly to work out, such as joins: all rows are then numbered to be dealt.
    """
    left, right, condition = sided(left, right, residual)
    return meet(left, right, on, condition, choose_split(left, right, on, split), left_id, right_id, apart)
