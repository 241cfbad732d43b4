"""One-row reports on join results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conflux.operators.inequality import running_extremes


def _report(size: Column, first_us: Column, last_us: Column) -> list[Column]:
    elapsed = F.floor((last_us - first_us) / 1000).cast("bigint")
    # Within a millisecond there is no rate to speak of: null instead of a division by zero.
    rate = F.when(elapsed > 0, F.floor(size / elapsed).cast("bigint"))
    return [
        size.alias("size"),
        first_us.alias("first_us"),
        last_us.alias("last_us"),
        elapsed.alias("elapsed_ms"),
        rate.alias("per_ms"),
    ]


def join_summary(pairs: DataFrame, first: Column, last: Column) -> DataFrame:
    """Size of a join result, first start and last end (timestamps, out in microseconds), time between
    them, and rows per millisecond."""
    totals = pairs.agg(
        F.count(F.lit(1)).alias("size"),
        F.unix_micros(F.min(first)).alias("first_us"),
        F.unix_micros(F.max(last)).alias("last_us"),
    )
    return totals.select(*_report(F.col("size"), F.col("first_us"), F.col("last_us")))


def equi_join_summary(
    left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], left_ts: str, right_ts: str
) -> DataFrame:
    """What ``join_summary`` reports of an equality join, without building its pairs.

    Each side is reduced to one row per key first, so neither hot keys nor the size of the result
    matter.
    """

    def per_key(df: DataFrame, keys: list[str], ts: str, side: str) -> DataFrame:
        return df.groupBy(*[F.col(k).alias(f"{side}_{i}") for i, k in enumerate(keys)]).agg(
            F.count(F.lit(1)).alias(f"{side}_n"),
            F.min(ts).alias(f"{side}_first"),
            F.max(ts).alias(f"{side}_last"),
        )

    l = per_key(left, [a for a, _ in on], left_ts, "l")
    r = per_key(right, [b for _, b in on], right_ts, "r")
    same = [F.col(f"l_{i}") == F.col(f"r_{i}") for i in range(len(on))]
    totals = l.join(r, same).agg(
        F.coalesce(F.sum(F.col("l_n") * F.col("r_n")), F.lit(0)).alias("size"),
        F.unix_micros(F.min(F.least("l_first", "r_first"))).alias("first_us"),
        F.unix_micros(F.max(F.greatest("l_last", "r_last"))).alias("last_us"),
    )
    return totals.select(*_report(F.col("size"), F.col("first_us"), F.col("last_us")))


def chain_summary(relations: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """What ``join_summary`` reports of all a, b, c, ... with ``a.key < b.key < c.key < ...``, without building them.

    ``relations`` gives each relation's table, key and time column. Every relation is reduced to one row per key. From the second
    one on, a key takes the totals of the smaller keys of the chain so far, read off running totals; so the work is that
    of sorting the distinct keys. Sizes are decimals, as chains of a few relations pass a long.
    """

    def per_key(df: DataFrame, key: str, ts: str) -> DataFrame:
        return df.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("k")).agg(
            F.count(F.lit(1)).cast("decimal(38,0)").alias("n"),
            F.unix_micros(F.min(ts)).alias("first"),
            F.unix_micros(F.max(ts)).alias("last"),
        )

    chain = per_key(*relations[0])
    for relation in relations[1:]:
        smaller = running_extremes(chain, "k", ["n"], ["first"], ["last"], per_key(*relation))
        chain = smaller.where("n_before > 0").select(
            "k",
            (F.col("n_before") * F.col("n")).cast("decimal(38,0)").alias("n"),
            F.least("first_before", "first").alias("first"),
            F.greatest("last_before", "last").alias("last"),
        )
    totals = chain.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("decimal(38,0)").alias("size"), F.min("first").alias("first_us"), F.max("last").alias("last_us")
    )
    return totals.select(*_report(F.col("size"), F.col("first_us"), F.col("last_us")))


def batch_report(pairs: DataFrame, batch_id: int, first: Column, last: Column) -> DataFrame:
    """Size and latency of one micro-batch's result, and its ends, by which reports can be put together."""
    return join_summary(pairs, first, last).select(
        F.lit(batch_id).cast("bigint").alias("batch_id"), "size", F.col("elapsed_ms").alias("latency_ms"), "first_us", "last_us"
    )


def run_report(reports: DataFrame) -> DataFrame:
    """Size and latency of a whole run, from the reports of its micro-batches."""
    elapsed = F.floor((F.max("last_us") - F.min("first_us")) / 1000).cast("bigint")
    return reports.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), elapsed.alias("latency_ms"))
