"""TPC-H Q3 and Q5 join chains, at rest and over streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflux.operators.equi import choose_split, equi_join
from conflux.operators.split import Split, fits_broadcast, key_filter, measure_all

# The parameters of Q3.
SEGMENT = "FURNITURE"
DATE = "1995-03-29"
TOP = 10


def _per_key(df: DataFrame, *keys: str, as_name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(as_name))


def q3_revenue(
    customer: DataFrame, orders: DataFrame, lineitem: DataFrame, segment: str = SEGMENT, date: str = DATE
) -> DataFrame:
    """Revenue of each open order of a market segment.

    Where the orders are small they are broadcast, and line items are joined as they are read. Where
    not, line items are added up per order before the join: that needs the same exchange as the join
    on the order key, and lets an order with very many items shrink before it. Items of orders that aren't open are left out
    as they are read, by a bitmap of the open orders' keys.
    """
    cut = F.lit(date).cast("date")
    extra = [c for c in ("o_shippriority",) if c in orders.columns]
    chosen = customer.where(F.col("c_mktsegment") == segment).select("c_custkey")
    orders = orders.where(F.col("o_orderdate") < cut).select("o_orderkey", "o_custkey", "o_orderdate", *extra)
    open_orders = equi_join(chosen, orders, [("c_custkey", "o_custkey")])
    keys = ["o_orderkey", "o_orderdate", *extra]
    # Grouped, there is at most one row per row of the orders, whose size is checked here.
    small = fits_broadcast(orders)
    items = lineitem.where(F.col("l_shipdate") > cut)
    if not small:
        # No more open orders than orders of the time, which is a count over one column.
        items = key_filter(items, "l_orderkey", open_orders, "o_orderkey", orders.count())
        # The exchange that the join on the order key needs serves the grouping as well.
        open_orders = open_orders.repartition("o_orderkey")
    open_orders = _per_key(open_orders, *keys, as_name="copies")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    same = F.col("o_orderkey") == F.col("l_orderkey")
    if small:
        revenue = F.sum(price * F.col("copies")).alias("revenue")
        found = items.join(F.broadcast(open_orders), same).groupBy("l_orderkey", "o_orderdate", *extra).agg(revenue)
    else:
        earned = items.groupBy("l_orderkey").agg(F.sum(price).alias("earned"))
        found = open_orders.join(earned, same).withColumn("revenue", F.col("earned") * F.col("copies"))
    return found.select("l_orderkey", "revenue", "o_orderdate", *extra)


def q3_top(revenue: DataFrame, top: int = TOP) -> DataFrame:
    """The orders with most revenue; ties go to the earlier date, then to the lower key."""
    return revenue.orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(top)


def q3_count(customer: DataFrame, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Size of customer x orders x lineitem, without building it.

    Relations are reduced to their keys and how often they occur; what is left to do is to multiply
    the counts of keys that meet and to add up the products. Splits are measured on the relations
    as they are, so that nothing is aggregated twice.
    """
    items = lineitem.select("l_orderkey", F.lit(1).cast("bigint").alias("items"))
    return _total(customer, orders, items)


def _total(customer: DataFrame, orders: DataFrame, items: DataFrame) -> DataFrame:
    """The sum of ``items`` over all customer-order-item triples."""
    on = [("c_custkey", "o_custkey")]
    customer, orders = customer.select("c_custkey"), orders.select("o_orderkey", "o_custkey")
    split = choose_split(customer, orders, on, "auto")
    weights = (
        equi_join(_per_key(customer, "c_custkey", as_name="customers"), orders, on, split=split)
        .groupBy("o_orderkey")
        .agg(F.sum("customers").alias("order_weight"))
    )
    # There is at most one weight per row of the orders, whose size is checked here. Beyond it, items
    # are added up per order first, through the exchange that the join needs anyway.
    if fits_broadcast(orders):
        weights = F.broadcast(weights)
    else:
        items = items.groupBy("l_orderkey").agg(F.sum("items").alias("items"))
    met = items.join(weights, F.col("o_orderkey") == F.col("l_orderkey"))
    return met.agg(F.coalesce(F.sum(F.col("order_weight") * F.col("items")), F.lit(0)).alias("n"))


def q5_count(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    supplier: DataFrame,
    nation: DataFrame,
    region: DataFrame,
) -> DataFrame:
    """Size of the six-way chain down to region, counted like ``q3_count``.

    Suppliers are weighed by the nations and regions they belong to, and line items by their supplier.
    """
    regions = _per_key(region, "r_regionkey", as_name="regions")
    nation_weights = (
        equi_join(nation.select("n_nationkey", "n_regionkey"), regions, [("n_regionkey", "r_regionkey")])
        .groupBy("n_nationkey")
        .agg(F.sum("regions").alias("nation_weight"))
    )
    supplier, lineitem = supplier.select("s_suppkey", "s_nationkey"), lineitem.select("l_orderkey", "l_suppkey")
    if fits_broadcast(nation):
        nation_weights = F.broadcast(nation_weights)
    in_nation = [("s_nationkey", "n_nationkey")]
    supplier_weights = (
        equi_join(supplier, nation_weights, in_nation, split=choose_split(supplier, nation, in_nation, "auto"))
        .groupBy("s_suppkey")
        .agg(F.sum("nation_weight").alias("items"))
    )
    if fits_broadcast(supplier):
        supplier_weights = F.broadcast(supplier_weights)
    by_supplier = [("l_suppkey", "s_suppkey")]
    split = choose_split(lineitem, supplier, by_supplier, "auto")
    items = equi_join(lineitem, supplier_weights, by_supplier, split=split).select("l_orderkey", "items")
    return _total(customer, orders, items)


@dataclass(frozen=True)
class ChainSplits:
    """How the joins of a streaming chain divide their hot keys; fixed for the life of a checkpoint."""

    customer_orders: Split = Split()
    orders_lineitem: Split = Split()
    lineitem_supplier: Split = Split()
    supplier_nation: Split = Split()
    nation_region: Split = Split()

    @property
    def any(self) -> bool:
        return not all(split.whole for split in vars(self).values())


def chain_splits(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    supplier: DataFrame | None = None,
    nation: DataFrame | None = None,
    region: DataFrame | None = None,
) -> ChainSplits:
    """Measure the splits, in one job, on tables at rest, such as the history a stream starts with."""
    joins = {
        "customer_orders": (customer, orders, [("c_custkey", "o_custkey")]),
        "orders_lineitem": (orders, lineitem, [("o_orderkey", "l_orderkey")]),
    }
    if supplier is not None:
        joins["lineitem_supplier"] = lineitem, supplier, [("l_suppkey", "s_suppkey")]
    if nation is not None and region is not None:
        joins["supplier_nation"] = supplier, nation, [("s_nationkey", "n_nationkey")]
        joins["nation_region"] = nation, region, [("n_regionkey", "r_regionkey")]
    return ChainSplits(**dict(zip(joins, measure_all(list(joins.values())), strict=True)))


def q3_chain(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    splits: ChainSplits | None = None,
    stamps: bool = False,
    join: Callable[..., DataFrame] = equi_join,
) -> DataFrame:
    """Customer x orders x lineitem, over tables or streams, by equality joins of the kind ``join``.

    ``stamps`` adds the times of the micro-batches in which the customer-order pair (``pair_ts``) and
    the result (``emit_ts``) came out. Tables are measured when no splits are given.
    """
    splits = splits or _splits_of(customer, orders, lineitem)
    pairs = join(customer, orders, [("c_custkey", "o_custkey")], split=splits.customer_orders, apart=False)
    if stamps:
        pairs = pairs.withColumn("pair_ts", F.current_timestamp())
    joined = join(pairs, lineitem, [("o_orderkey", "l_orderkey")], split=splits.orders_lineitem, apart=False)
    return joined.withColumn("emit_ts", F.current_timestamp()) if stamps else joined


def q5_chain(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    supplier: DataFrame,
    nation: DataFrame | None = None,
    region: DataFrame | None = None,
    splits: ChainSplits | None = None,
    stamps: bool = False,
    join: Callable[..., DataFrame] = equi_join,
) -> DataFrame:
    """The chain to supplier, or to nation and region where these are given, over tables or streams.

    Nations are joined with regions, and suppliers with those, before they meet the line items: the
    few nation and region keys would otherwise each gather a share of all line items.
    """
    splits = splits or _splits_of(customer, orders, lineitem, supplier, nation, region)
    joined = q3_chain(customer, orders, lineitem, splits, stamps, join).drop("emit_ts")
    if nation is not None and region is not None:
        places = join(nation, region, [("n_regionkey", "r_regionkey")], split=splits.nation_region, apart=False)
        supplier = join(supplier, places, [("s_nationkey", "n_nationkey")], split=splits.supplier_nation, apart=False)
    joined = join(joined, supplier, [("l_suppkey", "s_suppkey")], split=splits.lineitem_supplier, apart=False)
    return joined.withColumn("emit_ts", F.current_timestamp()) if stamps else joined


def _splits_of(*inputs: DataFrame | None) -> ChainSplits:
    if any(df is not None and df.isStreaming for df in inputs):
        return ChainSplits()
    return chain_splits(*inputs)
