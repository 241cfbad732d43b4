"""Interleaving the documents of several sources to target weights by Pfair scheduling.

The documents of a source, in an order drawn by hash, are cut into blocks. Block i of a source with share w is released at
slot floor(i / w) and due at slot ceil((i + 1) / w). Of the released blocks, each slot takes the one that is due first;
so after any number of slots t a source has run between w t - 1 and w t + 1 blocks, both excluded. With whole-number weights
the schedule repeats after as many slots as they add up to, and only that period is worked out.

There may be any number of sources. Those whose share is too small for a slot of a period are dealt to classes. A class is
scheduled like a source, and the slots it gets are scheduled among its own sources in the same way, again with classes where
there are too many. So a class keeps within one block of its share, and a source within one block of its share of the class.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conflux.llm.tables import importable, merged, packed, saved

BLOCK = 32
# Slots of a period that weights made here are divided into. A source with less than a slot's share goes into a class.
PERIOD = 1000
# Weights made here rise with this power of a source's size, in parts of 1 / FINE.
EXPONENT, FINE = 0.5, 1024
# Documents of a source that one task numbers; a larger source is cut into ranges of its hash. Where a table has so many documents that
# sources of this size could be more than MOST_CUT, only those that hold 1 / MOST_CUT of it are cut: this bounds their list.
RANGE, MOST_CUT = 2048, 100_000
# Blocks of a source whose slots are worked out as one row.
SLOTS = 4096


def one_period(weights: list[int]) -> np.ndarray:
    """The source of each slot of a period: of the released blocks the one due first, then the one of the earlier source."""
    total = sum(weights)
    waiting = [(0, s, 0) for s, w in enumerate(weights) if w]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    order = np.empty(total, np.int64)
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // weights[s]), s, i))
        _, s, i = heapq.heappop(ready)
        order[slot] = s
        if i + 1 < weights[s]:
            heapq.heappush(waiting, ((i + 1) * total // weights[s], s, i + 1))
    return order


@dataclass(frozen=True)
class Phase:
    """Slots from ``start`` on, while a set of sources lasts: by source, its first block here and its slots in a period."""

    start: int
    period: int
    first: dict[int, int]
    slots: dict[int, np.ndarray]


def phases(blocks: list[int], weights: list[int]) -> Iterator[Phase]:
    """The whole schedule. When a source has run out, the others go on with their weights in a new phase."""
    left, done, start = list(blocks), [0] * len(blocks), 0
    while any(left):
        active = [s for s, n in enumerate(left) if n and weights[s]]
        shares = [weights[s] for s in active]
        if not active:
            active = [s for s, n in enumerate(left) if n]
            shares = [1] * len(active)
        common = reduce(gcd, shares)
        shares = [w // common for w in shares]
        order = one_period(shares)
        at_all = np.split(np.argsort(order, kind="stable"), np.cumsum(shares)[:-1])
        slots = dict(zip(active, at_all, strict=True))
        lacking = [left[s] // len(at) * len(order) + int(at[left[s] % len(at)]) for s, at in slots.items()]
        length = min(lacking)
        yield Phase(start, len(order), {s: done[s] for s in active}, slots)
        for s, at in slots.items():
            ran = length // len(order) * len(at) + int(np.searchsorted(at, length % len(order)))
            left[s] -= ran
            done[s] += ran
        start += length


_PLAN = "node string, child string, start long, period long, first long, n long, slots array<long>"


def _planned(edges: DataFrame, period: int | None) -> DataFrame:
    """The phases of each node's children: ``start`` and ``period`` in slots of the node, ``first`` block and number of blocks.

    With ``period``, weights are rounded to about so many slots; without, they are taken as they are.
    """
    importable(edges.sparkSession)

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["child"])
        weights, blocks = [r["weight"] for r in rows], [r["blocks"] for r in rows]
        if period:
            weights = [max(1, round(period * w / sum(weights))) for w in weights]
        child, figures, slots = [], [], []

        def ended(phase: Phase, first: dict[int, int]) -> None:
            for i, at in phase.slots.items():
                if n := first.get(i, blocks[i]) - phase.first[i]:
                    child.append(rows[i]["child"])
                    figures.append((phase.start, phase.period, phase.first[i], n))
                    slots.append(at)

        last = None
        for phase in phases(blocks, weights):
            if last:
                ended(last, phase.first)
            last = phase
        if last:
            ended(last, {})
        sizes = np.cumsum([0, *map(len, slots)])
        table = np.array(figures, np.int64).reshape(-1, 4)
        return pa.table(
            {
                "node": pa.array([rows[0]["node"]] * len(child), pa.string()),
                "child": pa.array(child, pa.string()),
                **{name: pa.array(table[:, k]) for k, name in enumerate(("start", "period", "first", "n"))},
                "slots": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([[], *slots]).astype(np.int64))),
            }
        )

    return edges.groupBy("node").applyInArrow(run, _PLAN)


def _tree(sources: DataFrame) -> tuple[DataFrame, int]:
    """``node``, ``child``, ``blocks``, ``weight``: what each node schedules, sources or classes; and the number of levels.

    A node has at most ``PERIOD`` sources with the share of a slot, and no more classes than slots for the others.
    """
    left, edges, level = sources.withColumn("node", F.col("band")), None, 0
    while edges is None or not left.isEmpty():
        totals = left.groupBy("node").agg(F.sum("weight").alias("total"))
        shared = left.join(totals, "node").withColumn("own", F.col("weight") * PERIOD >= F.col("total"))
        rest = shared.groupBy("node").agg(F.sum(F.when(~F.col("own"), F.col("weight"))).alias("rest"))
        classes = F.greatest(F.lit(1), F.floor(F.col("rest") * PERIOD / F.col("total")))
        of_class = F.concat("node", F.lit("?"), F.pmod(F.xxhash64(F.lit(level), "of"), classes).cast("string"))
        dealt = shared.join(rest, "node").withColumn("child", F.when(F.col("own"), F.col("of")).otherwise(of_class))
        dealt = saved(dealt.select("of", "blocks", "weight", "own", "node", "child"), "mix-level")
        here = dealt.groupBy("node", "child").agg(F.sum("blocks").alias("blocks"), F.sum("weight").alias("weight"))
        edges = here if edges is None else edges.unionByName(here)
        left = dealt.where(~F.col("own")).select("of", "blocks", "weight", F.col("child").alias("node"))
        level += 1
    return edges, level


def _slots(sources: DataFrame, period: int | None) -> DataFrame:
    """``of``, ``block``, ``slot`` of all blocks of the sources."""
    edges, levels = _tree(sources)
    plan = saved(_planned(edges, period), "mix-plan")
    parts = plan.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLOTS))))
    parts = parts.repartition("child", "first", "part")
    per_period = F.array_size("slots")

    def at(k):
        turn = F.floor(k / per_period) * F.col("period")
        slot = F.col("start") + turn + F.element_at("slots", (k % per_period + 1).cast("int"))
        return F.struct((F.col("first") + k).alias("block"), slot.cast("long").alias("slot"))

    ks = F.sequence(F.col("part") * SLOTS, F.least((F.col("part") + 1) * SLOTS, F.col("n")) - 1)
    each = parts.select("node", "child", F.explode(F.transform(ks, at)).alias("at")).select("node", "child", "at.*")
    is_class = F.col("child").contains("?") & F.col("child").rlike(r"^[01]")
    found = each.where(~is_class).withColumnRenamed("child", "of")
    above = each.where(is_class).select(
        F.col("child").alias("up"), F.col("block").alias("up_block"), F.col("node").alias("up_node"), F.col("slot").alias("up_slot")
    )
    # The slot of a class's source is a block of the class.
    for _ in range(levels - 1):
        found = found.join(above, (F.col("node") == F.col("up")) & (F.col("slot") == F.col("up_block")), "left")
        found = found.select("of", "block", F.coalesce("up_node", "node").alias("node"), F.coalesce("up_slot", "slot").alias("slot"))
    before = sources.where("band = '0'").agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("ahead"))
    late = F.when(F.col("node") == "1", F.col("ahead")).otherwise(0)
    # One row.
    return found.join(F.broadcast(before)).select("of", "block", (F.col("slot") + late).alias("slot"))


def mixed(
    docs: DataFrame,
    targets: Mapping[str | None, int] | None = None,
    id_column: str = "doc_id",
    source: str = "source",
    block: int = BLOCK,
) -> DataFrame:
    """``row`` (a struct of all columns), ``slot`` and ``position`` (slot, then place in its block) of every row.

    ``targets`` gives whole-number weights, whose sum by their greatest common divisor is the length of a period; without it
    they rise with the square root of a source's size. A source that has none runs after those that do. There may be any number of
    sources; nulls are a source like others. Every row comes out once, repeated rows as often as they are there; rows with the
    same id are in any order. Positions rise without repeats; after the last block of a source, which may be short, some are
    left out. Texts are moved but not read, so that long ones cost what they weigh. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    of = F.coalesce(F.concat(F.lit("="), F.col(f"row.`{source}`").cast("string")), F.lit("~"))
    # The drawn order of a source is that of a hash of the id; its upper bits choose the range.
    drawn = F.xxhash64(F.lit("mix"), f"row.`{id_column}`")
    named = packed(docs).withColumn("of", of).withColumn("drawn", drawn)

    sources = named.groupBy("of").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block))
    if targets is None:
        weight = F.greatest(F.lit(1), F.floor(F.pow("n", F.lit(EXPONENT)) * FINE))
        sources = sources.withColumn("weight", weight.cast("long")).withColumn("band", F.lit("0"))
    else:
        wanted = [("~" if s is None else f"={s}", int(w)) for s, w in targets.items() if w > 0]
        sources = sources.join(spark.createDataFrame(wanted, "of string, given long"), "of", "left")
        sources = sources.withColumn("weight", F.coalesce("given", F.lit(1).cast("long")))
        sources = sources.withColumn("band", F.when(F.col("given").isNull(), "1").otherwise("0"))
    sources = saved(sources.select("of", "n", "blocks", "weight", "band"), "mix-sources")
    slots = _slots(sources, PERIOD if targets is None else None)

    total = sources.agg(F.sum("n").alias("total"))
    large = sources.join(F.broadcast(total)).where((F.col("n") > RANGE) & (F.col("n") * MOST_CUT >= F.col("total")))
    ranges = F.broadcast(large.select("of", F.ceil(F.col("n") / RANGE).alias("ranges")))
    upper = F.shiftright("drawn", 32) + F.lit(1 << 31)
    dealt = named.join(ranges, "of", "left")
    dealt = dealt.select("row", "of", "drawn", F.shiftright(upper * F.coalesce("ranges", F.lit(1)), 32).alias("range"))
    sizes = dealt.groupBy("of", "range").count()
    sums = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("count").over(sums), F.lit(0)))
    # The slots of a range's blocks, some RANGE / block of them.
    touched = F.sequence(F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("count") - 1) / block))
    offsets = sizes.select("of", "range", "before", F.explode(touched).alias("block")).join(slots, ["of", "block"])
    offsets = offsets.groupBy("of", "range", "before").agg(F.sort_array(F.collect_list(F.struct("block", "slot"))).alias("at"))
    within = F.row_number().over(Window.partitionBy("of", "range").orderBy("drawn", f"row.`{id_column}`")) - 1
    numbered = dealt.withColumn("within", within).join(merged(offsets), ["of", "range"])
    n = F.col("before") + F.col("within")
    nth = F.floor(n / block) - F.floor(F.col("before") / block) + 1
    slot = F.element_at(F.col("at.slot"), nth.cast("int"))
    return numbered.select("row", slot.alias("slot"), n.alias("n")).select(
        "row", "slot", (F.col("slot") * block + F.col("n") % block).cast("long").alias("position")
    )


def in_mixed_order(mix: DataFrame, name: str = "mix_position") -> DataFrame:
    """The rows of ``mixed`` in files and rows by position: all columns of the documents, then the position.

    Underscores are added to ``name`` while the documents have a column of that name.
    """
    taken = {c.lower() for c in mix.schema["row"].dataType.names}
    while name.lower() in taken:
        name += "_"
    ordered = mix.repartitionByRange("position").sortWithinPartitions("position")
    return ordered.select("row.*", F.col("position").alias(name))
