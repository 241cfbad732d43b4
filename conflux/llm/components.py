"""Connected components of a table of edges by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflux.llm.tables import saved


def _to_minimum(pairs: DataFrame, keep) -> DataFrame:
    """Each kept neighbour of a node is linked to the smallest of the node and its neighbours."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.where(keep).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_minimum(both, F.col("v") > F.col("u")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("v"))
    linked = _to_minimum(down, F.lit(True))
    return linked.unionByName(least).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    code = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(code)).first())


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (``u``, ``v``, longs): the smallest node it is connected to.

    The rows of a round are the edges at most; a node with many edges is summed up before the shuffle, and its edges are
    joined to its minimum, which Spark can split. Each round is written to the shared folder. Loops and repeated edges
    may be present; an edge with a null is ignored.
    """
    now = edges.select("u", "v").where("u <> v").distinct()
    now = saved(now, "edges")
    state = _state(now)
    while state[0]:
        now = saved(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
