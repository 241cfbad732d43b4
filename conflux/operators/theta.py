"""Joins on arbitrary predicates, and cross joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflux.functions.columns import Predicate, condition_of, is_opaque, require_distinct_names
from conflux.operators.split import (
    Split,
    broadcast_limit,
    cells_for,
    fits_broadcast,
    grid_shape,
    measured,
    meet,
    parallelism,
    plan_bytes,
)

# Beyond this, a side named by the caller is not broadcast either.
HARD_BROADCAST_BYTES = 1 << 30


def measured_shape(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """The grid for two tables, from their row counts."""
    (n_left, _), (n_right, _) = measured(left.select(), right.select())
    return grid_shape(n_left, n_right, cells_for(n_left, n_right, parallelism(left)))


def grid_join(
    left: DataFrame,
    right: DataFrame,
    predicate: Predicate | None = None,
    shape: tuple[int, int] | None = None,
    left_id: Sequence[str] | None = None,
    right_id: Sequence[str] | None = None,
) -> DataFrame:
    """Theta join (cross join without a predicate) through a grid of cells, with neither side broadcast.

    The cell numbers also give Structured Streaming the equality it asks of stream-stream joins.
    Batch inputs are counted when no shape is given; a stream needs one.
    """
    condition = None if predicate is None else condition_of(left, right, predicate)
    if shape is None:
        if left.isStreaming or right.isStreaming:
            raise ValueError("a stream cannot be counted; pass the grid's shape")
        shape = measured_shape(left, right)
    if is_opaque(predicate) and tuple(shape) == (1, 1):
        # A grid of one cell would be a bare product; the pairs are to be made cell by cell.
        shape = (2, 1)
    return meet(left, right, [], condition, Split(*shape), left_id, right_id)


def theta_join(
    left: DataFrame,
    right: DataFrame,
    predicate: Predicate,
    side: str | None = "auto",
    shape: tuple[int, int] | None = None,
    left_id: Sequence[str] | None = None,
    right_id: Sequence[str] | None = None,
) -> DataFrame:
    """All pairs for which ``predicate(left, right)`` holds; columns are left, then right, for every ``side``.

    side="auto"   broadcast the smaller side if it is under the session's broadcast threshold by the
                  optimizer's estimate or, failing that, by count; otherwise use the grid
    side="left" / "right"   broadcast that side, unless it is counted to be over HARD_BROADCAST_BYTES
    side="grid"   never broadcast
    side=None     let Catalyst choose

    A Python predicate always takes the grid; a side to broadcast, or None, is refused.
    Of a stream and a table, the table is broadcast if it is under the threshold; a larger one needs a shape for the grid.
    """
    require_distinct_names(left, right)
    if is_opaque(predicate) and side not in ("auto", "grid"):
        raise ValueError("a Python predicate needs a grid, or an equality beside it (equi_join)")
    if side == "grid" or is_opaque(predicate):
        return grid_join(left, right, predicate, shape, left_id, right_id)
    condition = condition_of(left, right, predicate)
    if side is None:
        return left.crossJoin(right).where(condition)
    if side == "auto":
        if left.isStreaming and right.isStreaming:
            raise ValueError("two streams cannot be counted or broadcast; use grid_join with a shape")
        if left.isStreaming or right.isStreaming:
            return _with_table(left, right, predicate, condition, shape, left_id, right_id)
        limit = broadcast_limit(left)
        small = [s for s, df in (("left", left), ("right", right)) if fits_broadcast(df, limit)]
        if small:
            side = min(small, key=lambda s: plan_bytes(left if s == "left" else right))
        else:
            (n_left, bytes_left), (n_right, bytes_right) = measured(left, right)
            side = "left" if bytes_left < bytes_right else "right"
            if min(bytes_left, bytes_right) > limit:
                shape = shape or grid_shape(n_left, n_right, cells_for(n_left, n_right, parallelism(left)))
                return grid_join(left, right, predicate, shape, left_id, right_id)
    elif side in ("left", "right"):
        chosen = left if side == "left" else right
        if not fits_broadcast(chosen) and measured(chosen)[0][1] > HARD_BROADCAST_BYTES:
            return grid_join(left, right, predicate, shape, left_id, right_id)
    else:
        raise ValueError(f"side is 'auto', 'left', 'right', 'grid' or None, not {side!r}")
    if side == "left":
        return F.broadcast(left).crossJoin(right).where(condition)
    return left.crossJoin(F.broadcast(right)).where(condition)


def _with_table(left, right, predicate, condition, shape, left_id, right_id) -> DataFrame:
    """A stream, which can't be counted, and a table."""
    table = right if left.isStreaming else left
    if not fits_broadcast(table) and measured(table)[0][1] > broadcast_limit(table):
        if shape is None:
            raise ValueError("the table is over the broadcast threshold; pass a shape for the grid")
        return grid_join(left, right, predicate, shape, left_id, right_id)
    if left.isStreaming:
        return left.crossJoin(F.broadcast(right)).where(condition)
    return F.broadcast(left).crossJoin(right).where(condition)


def cross_join(left: DataFrame, right: DataFrame, side: str | None = "auto") -> DataFrame:
    """Every pair of rows."""
    return theta_join(left, right, lambda l, r: F.lit(True), side)
