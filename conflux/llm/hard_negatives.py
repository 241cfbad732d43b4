"""Hard negatives of anchors by Fagin's threshold algorithm over blocks of rows.

Each task holds blocks of rows with their components as integers and, for each component, the rows in its order. An anchor
reads these lists from the end that its own component's sign favours, scores the rows it meets, and stops as soon as no row it
has not met can reach what it still looks for: the sum of its products with the values the lists have come to is a bound
on their scores. What an anchor has found in one block bounds the search in the task's next one.

Anchors are searched for in groups of a fixed number, which are sent to all tasks; what reaches the driver or a task doesn't
grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conflux.llm.tables import arrow_map, saved

EVERY, POSITIVES, NEGATIVES = 100, 5, 5
# Shares, in percent, of the positive's score that a negative's score lies between.
LOW, HIGH = 80, 100
SCALE = 256
# Rows that are sorted and searched together, and anchors that are searched for in one pass over all rows.
BLOCK, GROUP = 4096, 16384
# Components are cut to this size, so that scores of up to 512 of them are exact.
LARGEST = 1 << 27
# Up to here products and their sums are exact in floating point.
_EXACT = 1 << 53


@dataclass
class Anchors:
    """A group of anchors; for negatives, also the ids and scores of each one's positives (-1 where there are fewer)."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    positives: np.ndarray | None = None
    scores: np.ndarray | None = None
    counts: np.ndarray | None = None


class Block:
    """Rows and, for each component, their order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
        self.inner = np.take_along_axis(vectors, self.order, axis=0)
        depths = [1 << k for k in range(20) if 1 << k < len(ids)]
        self.depths = np.array(depths, np.int64) if depths else np.array([1])
        # What the lists come to at each depth, from the greatest and from the least value on.
        self.falling = self.inner[len(ids) - self.depths]
        self.rising = self.inner[self.depths - 1]

    def bounds(self, anchor: np.ndarray) -> np.ndarray:
        """The most that rows beyond each depth can score."""
        return np.maximum(anchor, 0) @ self.falling.T + np.minimum(anchor, 0) @ self.rising.T

    def down_to(self, anchor: np.ndarray, start: int, end: int) -> np.ndarray:
        """Rows at depths ``start`` to ``end`` of the lists of the anchor's components that aren't 0."""
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        n = len(self.ids)
        return np.concatenate((self.order[n - end : n - start, up].ravel(), self.order[start:end, down].ravel()))

    def search(self, anchor: np.ndarray, goal, take) -> None:
        """Hand rows and scores to ``take`` until no other row can score ``goal()``; a goal of None ends it."""
        n, bounds, depth = len(self.ids), self.bounds(anchor), 0
        met = np.zeros(n, bool)
        top = np.maximum(anchor, 0) @ self.inner[-1] + np.minimum(anchor, 0) @ self.inner[0]
        while depth < n:
            wanted = goal()
            if wanted is None or (top if not depth else bounds[np.searchsorted(self.depths, depth)]) < wanted:
                return
            if not depth:
                step = min(8, n)
                depth_to = int(self.depths[min(np.searchsorted(self.depths, step), len(self.depths) - 1)])
            else:
                enough = np.flatnonzero(bounds < wanted)
                depth_to = int(self.depths[enough[0]]) if len(enough) else n
            # Lists as deep as this hold nearly all rows between them.
            if depth_to * np.count_nonzero(anchor) >= 2 * n or depth_to <= depth:
                depth_to = n
            if depth_to == n:
                rows = np.flatnonzero(~met)
            else:
                rows = np.unique(self.down_to(anchor, depth, depth_to))
                rows = rows[~met[rows]]
                met[rows] = True
            if len(rows):
                take(rows, self.vectors[rows] @ anchor)
            depth = depth_to


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` by score, then by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        few = scores >= least
        scores, ids = scores[few], ids[few]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Positives:
    """The first rows of an anchor's label."""

    def __init__(self, anchors: Anchors, k: int):
        self.anchors, self.k = anchors, k
        self.found = [(np.empty(0), np.empty(0, np.int64))] * len(anchors.ids)

    def read(self, block: Block) -> None:
        for i, anchor in enumerate(self.anchors.vectors):

            def goal(i=i):
                scores = self.found[i][0]
                return scores[-1] if len(scores) == self.k else -np.inf

            def take(rows, scores, i=i):
                fit = (block.labels[rows] == self.anchors.labels[i]) & (block.ids[rows] != self.anchors.ids[i])
                had = self.found[i]
                if len(had[0]) == self.k:
                    fit &= scores >= had[0][-1]
                if fit.any():
                    self.found[i] = _first(np.append(had[0], scores[fit]), np.append(had[1], block.ids[rows[fit]]), self.k)

            block.search(anchor, goal, take)

    def rows(self) -> Iterator[tuple]:
        for anchor, (scores, ids) in zip(self.anchors.ids.tolist(), self.found, strict=True):
            for score, row in zip(scores.tolist(), ids.tolist(), strict=True):
                yield anchor, row, int(score)


class Negatives:
    """The first rows of other labels in the window of each of an anchor's positives."""

    def __init__(self, anchors: Anchors, k: int):
        self.anchors, self.k = anchors, k
        self.found = [[(np.empty(0), np.empty(0, np.int64))] * n for n in anchors.counts.tolist()]
        # The least whole score of each window; where that is above the positive's own, the window is empty.
        self.least = -(-LOW * anchors.scores // 100)
        self.most = HIGH * anchors.scores // 100

    def read(self, block: Block) -> None:
        for i, anchor in enumerate(self.anchors.vectors):
            windows = [w for w in range(len(self.found[i])) if self.least[i, w] <= self.most[i, w]]
            if not windows:
                continue
            least, most = self.least[i], self.most[i]

            def goal(i=i, windows=windows, least=least):
                return min(self.found[i][w][0][-1] if len(self.found[i][w][0]) == self.k else least[w] for w in windows)

            def take(rows, scores, i=i, windows=windows, least=least, most=most, goal=goal):
                fit = np.flatnonzero((scores >= goal()) & (scores <= max(most[w] for w in windows)))
                fit = fit[block.labels[rows[fit]] != self.anchors.labels[i]]
                if not len(fit):
                    return
                scores, ids = scores[fit], block.ids[rows[fit]]
                for w in windows:
                    inside = (scores >= least[w]) & (scores <= most[w])
                    if inside.any():
                        had = self.found[i][w]
                        self.found[i][w] = _first(np.append(had[0], scores[inside]), np.append(had[1], ids[inside]), self.k)

            block.search(anchor, goal, take)

    def rows(self) -> Iterator[tuple]:
        for i, anchor in enumerate(self.anchors.ids.tolist()):
            for w, (scores, ids) in enumerate(self.found[i]):
                positive, own = int(self.anchors.positives[i, w]), int(self.anchors.scores[i, w])
                for score, row in zip(scores.tolist(), ids.tolist(), strict=True):
                    yield anchor, positive, own, row, int(score)


def _vectors(column: pa.Array, largest: float) -> np.ndarray:
    """Rows of whole numbers; as floating point, which is faster, where scores stay exact in it."""
    out = column.flatten().to_numpy(zero_copy_only=False)
    out = out.reshape(len(column), len(out) // max(1, len(column)))
    return out.astype(np.float64) if largest * largest * out.shape[1] < _EXACT else out.astype(np.int64)


def _searched(rows: DataFrame, anchors, kind, k: int, names: list[str], block_rows: int, largest: float) -> DataFrame:
    """The findings of ``kind`` of each task for the broadcast ``anchors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, rest, n = kind(anchors.value, k), [], 0

        def read() -> None:
            column = pa.Table.from_batches(rest).combine_chunks()
            ids, labels = (column.column(c).to_numpy() for c in ("id", "label"))
            search.read(Block(ids, labels, _vectors(column.column("vec").chunk(0), largest)))

        for whole in batches:
            for start in range(0, whole.num_rows, block_rows):
                batch = whole.slice(start, block_rows)
                rest.append(batch)
                n += batch.num_rows
                if n >= block_rows:
                    read()
                    rest, n = [], 0
        if n:
            read()
        found = list(search.rows())
        for start in range(0, len(found), 1 << 14):
            columns = zip(*found[start : start + (1 << 14)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return arrow_map(rows.select("id", "label", "vec"), run, ", ".join(f"{n} long" for n in names))


def _ranked(found: DataFrame, by: list[str], score: str, row: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), row)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def whole_numbers(vector: Column) -> Column:
    """floor(256 x) of each component, within +-2^27."""
    return F.transform(
        vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int")
    )


def hard_negatives(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    every: int = EVERY,
    block: int = BLOCK,
    group: int = GROUP,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows whose id is divisible by ``every``. Scores are inner products of floor(256 x); higher ones come first,
    ties by smaller id. An anchor's positives are its first five other rows of the same label, and of each, the first five
    rows of other labels are returned whose score is 80 to 100 % of the positive's; a negative positive has none.

    Rows with a null label, id or vector, or with a component that is null or not finite, take no part. Of rows with the same
    id one takes part, the one with the smallest label, then vector. A component beyond 2^27 after scaling counts as that.
    Vectors of different lengths are compared as if the shorter ones ended in zeros. An empty table has no anchors.
    """
    vector, label, row = (F.col(f"`{c}`") for c in (vector_column, label_column, id_column))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    named = rows.select(row.cast("long").alias("id"), label.cast("long").alias("label"), vector.alias("vec"))
    named = named.where(row.isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False)))
    named = named.select("id", "label", whole_numbers(F.col("vec")).alias("vec"))
    one = named.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("row")).select("id", "row.label", "row.vec")
    one = saved(one, "negatives-rows")
    largest = F.max(F.greatest(F.abs(F.array_max("vec")), F.abs(F.array_min("vec"))))
    size, shortest, most, n = one.agg(F.max(F.size("vec")), F.min(F.size("vec")), largest, F.count(F.when(F.col("id") % every == 0, 1))).first()
    if size != shortest:
        zeros = F.array_repeat(F.lit(0), F.lit(size) - F.size("vec"))
        one = one.withColumn("vec", F.concat("vec", zeros))
    groups = -(-n // group)
    anchors = saved(one.where(F.col("id") % every == 0).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(max(1, groups)))), "negatives-anchors")
    spark, results = rows.sparkSession, []
    most = float(most or 0)
    for part in range(groups):
        mine = anchors.where(F.col("part") == part)
        found = mine.select("id", "label", "vec").toArrow().combine_chunks()
        if not found.num_rows:
            continue
        ids, labels = (found.column(c).to_numpy() for c in ("id", "label"))
        vectors = _vectors(found.column("vec").chunk(0), most)
        shared = spark.sparkContext.broadcast(Anchors(ids, labels, vectors))
        positives = _searched(one, shared, Positives, POSITIVES, ["anchor_id", "positive_id", "positive_score"], block, most)
        positives = saved(_ranked(positives, ["anchor_id"], "positive_score", "positive_id", POSITIVES), "negatives-positives")
        known = _with_positives(Anchors(ids, labels, vectors), positives)
        shared.destroy()
        shared = spark.sparkContext.broadcast(known)
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        negatives = _searched(one, shared, Negatives, NEGATIVES, names, block, most)
        ranked = _ranked(negatives, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES)
        ranked = ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        results.append(saved(ranked, "negatives-found"))
        shared.destroy()
    if not results:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _with_positives(anchors: Anchors, positives: DataFrame) -> Anchors:
    """``anchors``, a group, with its positives."""
    found = positives.select("anchor_id", "rank", "positive_id", "positive_score").toArrow()
    of, rank, ids, scores = (found.column(c).to_numpy() for c in found.column_names)
    order = np.argsort(anchors.ids, kind="stable")
    at = order[np.searchsorted(anchors.ids[order], of)]
    out = [np.full((len(anchors.ids), POSITIVES), -1, np.int64) for _ in range(2)]
    out[0][at, rank - 1], out[1][at, rank - 1] = ids, scores
    return Anchors(anchors.ids, anchors.labels, anchors.vectors, *out, np.bincount(at, minlength=len(anchors.ids)))
