"""The queries of this repository by name, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import timedelta
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conflux.functions.columns import arrow_predicate, earliest, prefixed, row_message, split_field, stamped
from conflux.operators.equi import choose_split, equi_join
from conflux.operators.inequality import inequality_join, running_totals
from conflux.operators.interval import bucket_splits, interval_chain, interval_join, multiplied, window_counts
from conflux.operators.split import Split, measure, parallelism, state_partitions
from conflux.operators.summary import chain_summary, equi_join_summary, run_report
from conflux.operators.theta import cross_join, grid_join, measured_shape, theta_join
from conflux.plans import tpch
from conflux.session import work_folder
from conflux.sources.files import delimited_table, int_relation, table, table_stream, text_lines
from conflux.sources.generators import random_key
from conflux.sources.schemas import TPCH
from conflux.streaming.joins import stored_chain, stored_interval_join, stored_join, stored_theta_join, stream_join, stream_window_counts
from conflux.streaming.lateness import files_per_batch, in_time_order, measured_lateness
from conflux.streaming.progress import PROGRESS_COLUMNS, observed, observed_reports, progress_table
from conflux.streaming.run import Run, run_batches, run_to_table
from conflux.streaming.store import BatchFolder, store_stream

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WITHIN = timedelta(minutes=10)

# Bounds the micro-batches of streams without a watermark, whose result does not depend on them.
_FILES_PER_BATCH = 4096


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # events.ts carries no time zone; event-time columns are made from it as UTC.
            zone = spark.conf.get("spark.sql.session.timeZone")
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            try:
                return fn(spark, folder)
            finally:
                spark.conf.set("spark.sql.session.timeZone", zone)

        QUERIES[name or fn.__name__] = run
        if sql is not None:
            ORACLES[name or fn.__name__] = sql
        return run

    return register


# ---- inputs ------------------------------------------------------------------------------------


def _events(events: DataFrame, kind: str, prefix: str) -> DataFrame:
    """Events of one type: id, user and time, with prefixed names."""
    chosen = events.where(F.col("event_type") == kind)
    row = [c for c in ("row",) if c in events.columns]
    return prefixed(chosen.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), *row), prefix)


def _clicks_purchases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, folder, "events")
    return _events(events, "click", "click_"), _events(events, "purchase", "purchase_")


def _stream_events(spark: SparkSession, folder: str, kind: str, numbered: bool, max_files: int | None = None) -> DataFrame:
    """Events of one type as a stream; ``numbered`` adds a number per row to deal copies by."""
    stream = table_stream(spark, folder, "events", max_files=max_files, row_id="row" if numbered else None)
    return _events(stream, kind, f"{kind}_")


def _stream_clicks_purchases(
    spark: SparkSession, folder: str, numbered: bool = False, max_files: int | None = _FILES_PER_BATCH
) -> list[DataFrame]:
    return [_stream_events(spark, folder, kind, numbered, max_files) for kind in ("click", "purchase")]


def _keys(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return table(spark, folder, name).select(*columns)


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    return _keys(spark, folder, "region", "r_regionkey")


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    return _keys(spark, folder, "nation", "n_nationkey")


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return _keys(spark, folder, "supplier", "s_suppkey")


def _streamed(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return table_stream(spark, folder, name, max_files=_FILES_PER_BATCH).select(*columns)


def _streamed_rows(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table as a stream, with a number per row to deal copies by."""
    rows = table_stream(spark, folder, name, max_files=_FILES_PER_BATCH, row_id=f"{name}_row")
    return rows.select(*columns, f"{name}_row")


def _grid(left: DataFrame, right: DataFrame) -> Split:
    """A grid for streams of two tables, from the tables' sizes."""
    return Split(*measured_shape(left, right))


# ---- sources and expressions -------------------------------------------------------------------

_CUSTOMER_FIELDS = "c_custkey, c_name, c_nationkey, c_mktsegment"


def _customer_lines(spark: SparkSession, folder: str) -> str:
    """The customer table as bar-separated lines ending in a bar, in a folder of text files."""
    path = work_folder(spark, "customer-lines")
    fields = [F.col(c.strip()).cast("string") for c in _CUSTOMER_FIELDS.split(",")]
    lines = table(spark, folder, "customer").select(F.concat(F.concat_ws("|", *fields), F.lit("|")))
    lines.write.text(path)
    return path


@query(f"select {_CUSTOMER_FIELDS} from customer")
def tbl_scan(spark, folder):
    schema = table(spark, folder, "customer").select(*_CUSTOMER_FIELDS.split(", ")).schema
    return delimited_table(spark, _customer_lines(spark, folder), schema)


@query(
    """select o_orderkey, o_custkey, o_orderstatus, cast(o_orderdate as date) as o_orderdate, o_orderpriority,
    0 as o_shippriority from orders"""
)
def tbl_schema_scan(spark, folder):
    """Orders as text in the full layout, the columns the table lacks filled in, read by their published types."""
    orders = table(spark, folder, "orders")
    known = {
        "o_totalprice": F.col("o_totalprice").cast("decimal(15,2)"),
        "o_orderdate": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "o_clerk": F.lit("Clerk"),
        "o_shippriority": F.lit(0),
        "o_comment": F.lit("none"),
    }
    fields = [known.get(f.name, F.col(f.name)) for f in StructType.fromDDL(TPCH["orders"]).fields]
    path = work_folder(spark, "orders-lines")
    orders.select(F.concat(F.concat_ws("|", *[f.cast("string") for f in fields]), F.lit("|"))).write.text(path)
    read = delimited_table(spark, path, TPCH["orders"])
    return read.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "o_shippriority")


@query("select c_custkey, c_nationkey, true as stamped from customer")
def arrival_stamp(spark, folder):
    """Each row with the time at which it came in, which is the same for all and not in the future."""
    rows = stamped(_keys(spark, folder, "customer", "c_custkey", "c_nationkey"))
    instant = rows.agg(F.min("arrival_ts").alias("low"), F.max("arrival_ts").alias("high"))
    sound = F.coalesce(F.col("low") == F.col("high"), F.lit(False)) & (F.col("arrival_ts") <= F.current_timestamp())
    # One row of two times.
    return rows.crossJoin(F.broadcast(instant)).select("c_custkey", "c_nationkey", sound.alias("stamped"))


@query("select c_custkey, o_orderkey from customer join orders on c_custkey = o_custkey where c_mktsegment = 'BUILDING'")
def transform_join(spark, folder):
    """The joins as methods of a DataFrame."""
    buyers = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = _keys(spark, folder, "orders", "o_orderkey", "o_custkey")
    return buyers.transform(equi_join, orders, [("c_custkey", "o_custkey")]).select("c_custkey", "o_orderkey")


@query("select c_custkey, c_nationkey from customer")
def split_cast(spark, folder):
    lines = text_lines(spark, _customer_lines(spark, folder))
    return lines.select(
        split_field(F.col("value"), 0, "bigint").alias("c_custkey"),
        split_field(F.col("value"), 2).alias("c_nationkey"),
    )


@query('select c_nationkey as "key" from customer', name="int_relation")
def int_relation_scan(spark, folder):
    path = work_folder(spark, "int-relation")
    table(spark, folder, "customer").select(F.col("c_nationkey").cast("string")).write.text(path)
    return int_relation(spark, path).select("key")


# The rounds of the generator in SQL, for a column x of words of 32 bits.
_MIX_SQL = "(xor({x}, {x} >> 16) * 2146121005) & 4294967295", "(xor({x}, {x} >> 15) * 739982445) & 4294967295", "xor({x}, {x} >> 16)"


def _mix_sql(column: str, source: str) -> str:
    for part in _MIX_SQL:
        source = f"select * replace ({part.format(x=column)} as {column}) from ({source})"
    return source


@query(
    f"""select o_orderkey, ((x * 10) >> 32)::int as "key"
    from ({_mix_sql('x', f"""select o_orderkey, xor(x, high) as x
        from ({_mix_sql('x', f"""select o_orderkey, o_orderkey >> 32 as high, xor(o_orderkey & 4294967295, s) as x
            from orders, ({_mix_sql('s', 'select 42::bigint as s')})""")})""")})"""
)
def key_generator(spark, folder):
    """A random key for each order, the same on every machine."""
    orders = _keys(spark, folder, "orders", "o_orderkey")
    return orders.select("o_orderkey", random_key(F.col("o_orderkey"), 0, 10, seed=42).alias("key"))


@query(
    """select concat_ws(',', s_suppkey, s_name, s_nationkey) as "key",
       cast(json_object('s_suppkey', s_suppkey, 's_name', s_name, 's_nationkey', s_nationkey) as varchar) as "value"
    from supplier"""
)
def row_to_message(spark, folder):
    return row_message(_keys(spark, folder, "supplier", "s_suppkey", "s_name", "s_nationkey"))


@query(
    """select l_orderkey, l_linenumber, l_quantity from lineitem
    where l_returnflag = 'R' and l_quantity >= 25 and l_discount < 0.05"""
)
def predicate_filter(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    kept = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 25) & (F.col("l_discount") < 0.05)
    return lineitem.where(kept).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    """select 'customer' as relation, count(*) as n from customer where c_mktsegment = 'FURNITURE'
    union all select 'orders', count(*) from orders where o_orderdate < date '1995-03-29'
    union all select 'lineitem', count(*) from lineitem where l_shipdate > date '1995-03-29'"""
)
def q3_filters(spark, folder):
    cut = F.lit(tpch.DATE).cast("date")
    kept = {
        "customer": F.col("c_mktsegment") == tpch.SEGMENT,
        "orders": F.col("o_orderdate") < cut,
        "lineitem": F.col("l_shipdate") > cut,
    }
    counts = [
        table(spark, folder, name).where(test).agg(F.lit(name).alias("relation"), F.count(F.lit(1)).alias("n"))
        for name, test in kept.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as revenue from lineitem")
def revenue_expr(spark, folder):
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(revenue, 4).alias("revenue")
    )


_PAIRS_SQL = """from events a join events b on a.user_id = b.user_id
    and a.event_type = 'click' and b.event_type = 'purchase'"""

_ORDERED_SQL = _PAIRS_SQL + " and a.ts < b.ts"


@query(
    """select a.event_id as click_event_id, b.event_id as purchase_event_id,
       epoch_us(least(a.ts, b.ts)) as first_us """
    + _PAIRS_SQL
)
def earliest_stamp(spark, folder):
    pairs = equi_join(*_clicks_purchases(spark, folder), [("click_user_id", "purchase_user_id")])
    first = F.unix_micros(earliest(F.col("click_ts"), F.col("purchase_ts")))
    return pairs.select("click_event_id", "purchase_event_id", first.alias("first_us"))


@query("select a.user_id as user_id, epoch_us(a.ts) as first_us, epoch_us(b.ts) as emit_us " + _ORDERED_SQL)
def pair_project(spark, folder):
    pairs = _ordered(*_clicks_purchases(spark, folder))
    return pairs.select(
        F.col("click_user_id").alias("user_id"),
        F.unix_micros("click_ts").alias("first_us"),
        F.unix_micros("purchase_ts").alias("emit_us"),
    )


@query(
    """select event_id, user_id, 'click' as side from events where event_type = 'click'
    union all select event_id, user_id, 'purchase' from events where event_type = 'purchase'"""
)
def union_all(spark, folder):
    events = table(spark, folder, "events")
    parts = [
        events.where(F.col("event_type") == side).select("event_id", "user_id", F.lit(side).alias("side"))
        for side in ("click", "purchase")
    ]
    return parts[0].unionByName(parts[1])


# ---- batch joins -------------------------------------------------------------------------------


@query("select c_custkey, o_orderkey from customer join orders on c_custkey = o_custkey", name="equi_join")
def equi_join_keys(spark, folder):
    customer = _keys(spark, folder, "customer", "c_custkey")
    orders = _keys(spark, folder, "orders", "o_orderkey", "o_custkey")
    return equi_join(customer, orders, [("c_custkey", "o_custkey")]).select("c_custkey", "o_orderkey")


@query("select a.event_id as click_event_id, b.event_id as purchase_event_id " + _PAIRS_SQL)
def equi_split(spark, folder):
    """The click-purchase join with its keys measured and split even where they are small."""
    clicks, purchases = _clicks_purchases(spark, folder)
    on = [("click_user_id", "purchase_user_id")]
    # A thousandth of the rows is to be the most one cell takes of one key.
    split = measure(clicks, purchases, on, rows_per_cell=max(1, clicks.count() // 1000))
    return equi_join(clicks, purchases, on, split=split).select("click_event_id", "purchase_event_id")


_Q3_TABLES = ("customer", "orders", "lineitem")
_Q5_TABLES = (*_Q3_TABLES, "supplier", "nation", "region")

_Q3_FROM = "from customer, orders, lineitem where c_custkey = o_custkey and l_orderkey = o_orderkey"
_Q5_FROM = """from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
    join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey"""


def _tpch(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [table(spark, folder, name) for name in names]


@query(f"select count(*) as n {_Q3_FROM}")
def q3_join_count(spark, folder):
    return tpch.q3_count(*_tpch(spark, folder, *_Q3_TABLES))


@query(f"select count(*) as n {_Q5_FROM}")
def q5_join_count(spark, folder):
    return tpch.q5_count(*_tpch(spark, folder, *_Q5_TABLES))


_CHAIN_COLUMNS = {
    "customer": ("c_custkey",),
    "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey", "l_suppkey"),
    "supplier": ("s_suppkey", "s_nationkey"),
    "nation": ("n_nationkey", "n_regionkey"),
    "region": ("r_regionkey",),
}


def _chain_keys(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [_keys(spark, folder, name, *_CHAIN_COLUMNS[name]) for name in names]


_Q3_KEYS = ("c_custkey", "o_orderkey", "l_suppkey")
_Q5_KEYS = ("c_custkey", "o_orderkey", "s_suppkey", "n_nationkey", "r_regionkey")


@query(f"select {', '.join(_Q3_KEYS)} {_Q3_FROM}")
def q3_chain(spark, folder):
    return tpch.q3_chain(*_chain_keys(spark, folder, *_Q3_TABLES)).select(*_Q3_KEYS)


@query(f"select {', '.join(_Q5_KEYS)} {_Q5_FROM}")
def q5_chain(spark, folder):
    return tpch.q5_chain(*_chain_keys(spark, folder, *_Q5_TABLES)).select(*_Q5_KEYS)


_Q3_SQL = """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue,
    strftime(o_orderdate, '%Y-%m-%d') as o_orderdate
    from customer, orders, lineitem
    where c_mktsegment = 'FURNITURE' and c_custkey = o_custkey and l_orderkey = o_orderkey
    and o_orderdate < date '1995-03-29' and l_shipdate > date '1995-03-29'
    group by l_orderkey, orders.o_orderdate"""


def _q3_shown(revenue: DataFrame) -> DataFrame:
    return revenue.select(
        "l_orderkey",
        F.round("revenue", 4).alias("revenue"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
    )


@query(_Q3_SQL)
def q3_revenue(spark, folder):
    return _q3_shown(tpch.q3_revenue(*_tpch(spark, folder, *_Q3_TABLES)))


@query(_Q3_SQL + " order by sum(l_extendedprice * (1 - l_discount)) desc, orders.o_orderdate, l_orderkey limit 10")
def q3_topk(spark, folder):
    return _q3_shown(tpch.q3_top(tpch.q3_revenue(*_tpch(spark, folder, *_Q3_TABLES))))


_GE_SQL = "select s_suppkey, n_nationkey from supplier join nation on s_suppkey >= n_nationkey"
_LT_SQL = "select n_nationkey, s_suppkey from nation join supplier on n_nationkey < s_suppkey"


@query(_GE_SQL)
def theta_ge(spark, folder):
    return theta_join(_suppliers(spark, folder), _nations(spark, folder), lambda s, n: s.s_suppkey >= n.n_nationkey)


@query(_GE_SQL)
def theta_grid(spark, folder):
    return grid_join(_suppliers(spark, folder), _nations(spark, folder), lambda s, n: s.s_suppkey >= n.n_nationkey)


@query(_LT_SQL)
def theta_range(spark, folder):
    """The inequality join over key ranges."""
    return inequality_join(_nations(spark, folder), _suppliers(spark, folder), "n_nationkey", "<", "s_suppkey")


@query("select n_nationkey, s_suppkey from nation join supplier on (n_nationkey * 7 + s_suppkey) % 10 < n_nationkey % 4")
def python_theta(spark, folder):
    """A join on a Python function, which Catalyst can't look into: the pairs of each cell in Arrow batches."""

    def close(nation: pa.Array, supplier: pa.Array) -> pa.Array:
        return pa.array((nation.to_numpy() * 7 + supplier.to_numpy()) % 10 < nation.to_numpy() % 4)

    predicate = arrow_predicate(close, ["n_nationkey"], ["s_suppkey"])
    return theta_join(_nations(spark, folder), _suppliers(spark, folder), predicate)


@query("select n_nationkey, s_suppkey from nation cross join supplier", name="cross_join")
def cross_join_pairs(spark, folder):
    return cross_join(_nations(spark, folder), _suppliers(spark, folder))


def _less(n, s):
    return n.n_nationkey < s.s_suppkey


@query(_LT_SQL)
def broadcast_theta(spark, folder):
    return theta_join(_nations(spark, folder), _suppliers(spark, folder), _less, side="left")


@query(_LT_SQL)
def auto_side_theta(spark, folder):
    return theta_join(_nations(spark, folder), _suppliers(spark, folder), _less, side="auto")


@query(_LT_SQL)
def filtered_cross(spark, folder):
    return cross_join(_nations(spark, folder), _suppliers(spark, folder)).where("n_nationkey < s_suppkey")


@query(_LT_SQL)
def oriented_join(spark, folder):
    """The same pairs with the inputs the other way round; the columns keep their names."""
    found = theta_join(_suppliers(spark, folder), _nations(spark, folder), lambda s, n: _less(n, s), side="auto")
    return found.select("n_nationkey", "s_suppkey")


_CHAIN_SQL = """from region join nation on r_regionkey < n_nationkey join supplier on n_nationkey < s_suppkey"""


def _chain(spark: SparkSession, folder: str) -> DataFrame:
    pairs = theta_join(_regions(spark, folder), _nations(spark, folder), lambda r, n: r.r_regionkey < n.n_nationkey)
    return theta_join(pairs, _suppliers(spark, folder), _less)


@query(f"select n_nationkey, s_suppkey {_CHAIN_SQL}")
def lt_chain(spark, folder):
    return _chain(spark, folder).select("n_nationkey", "s_suppkey")


@query(f"select r_regionkey, n_nationkey, s_suppkey {_CHAIN_SQL}")
def lt_chain_triples(spark, folder):
    return _chain(spark, folder)


def _counted(spark: SparkSession, folder: str, **keys: str) -> DataFrame:
    """For every key of the named tables: its rows in each, and those of smaller and greater keys."""
    tagged = [
        table(spark, folder, name).select(
            F.col(column).cast("bigint").alias("k"),
            *[F.lit(int(name == other)).cast("bigint").alias(other) for other in keys],
        )
        for name, column in keys.items()
    ]
    return running_totals(reduce(DataFrame.unionByName, tagged), "k", {name: F.sum(name) for name in keys})


@query(f"select count(*) as n {_CHAIN_SQL}")
def lt_chain_count(spark, folder):
    """Size of the chain without its triples: each nation, times the regions below, times the suppliers above."""
    counted = _counted(spark, folder, region="r_regionkey", nation="n_nationkey", supplier="s_suppkey")
    triples = F.col("region_before") * F.col("nation") * F.col("supplier_after")
    return counted.agg(F.coalesce(F.sum(triples), F.lit(0)).alias("n"))


@query("select count(*) as n from customer join orders on c_custkey < o_custkey")
def theta_count(spark, folder):
    """Size of an inequality join of two large tables, without its pairs."""
    counted = _counted(spark, folder, customer="c_custkey", orders="o_custkey")
    return counted.agg(F.coalesce(F.sum(F.col("customer_before") * F.col("orders")), F.lit(0)).alias("n"))


def _ordered(clicks: DataFrame, purchases: DataFrame, **options) -> DataFrame:
    on = [("click_user_id", "purchase_user_id")]
    return equi_join(clicks, purchases, on, lambda c, p: c.click_ts < p.purchase_ts, **options)


@query("select a.event_id as click_event_id, b.event_id as purchase_event_id " + _ORDERED_SQL)
def ordered_equi(spark, folder):
    return _ordered(*_clicks_purchases(spark, folder)).select("click_event_id", "purchase_event_id")


@query(
    """with pairs as (select least(a.ts, b.ts) as first, greatest(a.ts, b.ts) as last """
    + _PAIRS_SQL
    + """), totals as (select count(*) as size, epoch_us(min(first)) as first_us, epoch_us(max(last)) as last_us
    from pairs)
    select size, first_us, last_us, (last_us - first_us) // 1000 as elapsed_ms,
    size // nullif((last_us - first_us) // 1000, 0) as per_ms from totals""",
    name="join_summary",
)
def join_summary_row(spark, folder):
    clicks, purchases = _clicks_purchases(spark, folder)
    on = [("click_user_id", "purchase_user_id")]
    return equi_join_summary(clicks, purchases, on, "click_ts", "purchase_ts")


# ---- joins within a time interval --------------------------------------------------------------

_NEAR = "abs(epoch_us({}.ts) - epoch_us({}.ts)) <= 600000000"
_INTERVAL_SQL = f"""from events a join events b on a.event_type = 'click' and b.event_type = 'purchase'
    and {_NEAR.format('a', 'b')}"""
_INTERVAL3_SQL = f"{_INTERVAL_SQL} join events c on c.event_type = 'view' and {_NEAR.format('a', 'c')}"

_IDS2 = "a.event_id as click_event_id, b.event_id as purchase_event_id"
_IDS3 = _IDS2 + ", c.event_id as view_event_id"
_EVENT_IDS = ["click_event_id", "purchase_event_id", "view_event_id"]

# Tasks for interval joins that give far more rows than they read.
_TASKS_PER_CORE = 4


def _near(clicks: DataFrame, purchases: DataFrame, **options) -> DataFrame:
    return interval_join(clicks, purchases, "click_ts", "purchase_ts", WITHIN, **options)


@query(f"select {_IDS2} {_INTERVAL_SQL}", name="interval_join")
def interval_join_pairs(spark, folder):
    return _near(*_clicks_purchases(spark, folder)).select(*_EVENT_IDS[:2])


def _near_lists(clicks: DataFrame, purchases: DataFrame, views: DataFrame, splits: list[Split] | None = None) -> DataFrame:
    """Clicks with lists of the ids of purchases and of views near them, to be multiplied out."""
    others = [(purchases, "purchase_ts"), (views, "view_ts")]
    tasks = _TASKS_PER_CORE * parallelism(clicks)
    found = interval_chain(clicks, "click_ts", others, WITHIN, splits, tasks=tasks, lists=["purchase", "view"])
    return found.select("click_event_id", *[F.col(f"{kind}.{kind}_event_id") for kind in ("purchase", "view")])


@query(f"select {_IDS3} {_INTERVAL3_SQL}")
def interval_join3(spark, folder):
    events = table(spark, folder, "events")
    kinds = [_events(events, kind, f"{kind}_").select(f"{kind}_event_id", f"{kind}_ts") for kind in ("click", "purchase", "view")]
    return multiplied(_near_lists(*kinds), _EVENT_IDS[1:])


_WINDOW_SQL = """select start as window_start, event_type, count(*) as n from
    (select event_type, unnest([epoch_us(ts) // 300000000 * 300, epoch_us(ts) // 300000000 * 300 - 300]) as start
     from events) group by start, event_type"""


@query(_WINDOW_SQL)
def window_count(spark, folder):
    events = table(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return window_counts(events, "ts", ["event_type"], "10 minutes", "5 minutes")


@query(
    """with c as (select user_id as k, count(*) as n, min(ts) as f, max(ts) as l from events
                 where event_type = 'click' group by 1),
    p as (select user_id as k, count(*) as n, min(ts) as f, max(ts) as l from events
          where event_type = 'purchase' group by 1),
    v as (select user_id as k, count(*) as n, min(ts) as f, max(ts) as l from events
          where event_type = 'view' group by 1),
    t as (select sum(c.n::hugeint * p.n * v.n) as size, epoch_us(min(least(c.f, p.f, v.f))) as first_us,
          epoch_us(max(greatest(c.l, p.l, v.l))) as last_us
          from c join p on c.k < p.k join v on p.k < v.k)
    select cast(size as bigint) as size, first_us, last_us, (last_us - first_us) // 1000 as elapsed_ms,
    cast(size as bigint) // ((last_us - first_us) // 1000) as per_ms from t""",
    name="lt_chain_summary",
)
def lt_chain_summary_query(spark, folder):
    """Size, span and rate of the chain click < purchase < view by user, without its triples."""
    events = table(spark, folder, "events")
    kinds = [_events(events, kind, f"{kind}_") for kind in ("click", "purchase", "view")]
    chain = [(df, f"{kind}_user_id", f"{kind}_ts") for df, kind in zip(kinds, ("click", "purchase", "view"), strict=True)]
    return chain_summary(chain).withColumn("size", F.col("size").cast("bigint"))


# ---- streaming ---------------------------------------------------------------------------------


@query("select c_custkey, c_nationkey from customer")
def stream_store(spark, folder):
    customer = _streamed(spark, folder, "customer", "c_custkey", "c_nationkey")
    return store_stream(customer, "stream-store").select("c_custkey", "c_nationkey")


@query("select c_custkey, c_nationkey from customer")
def stream_text_sink(spark, folder):
    """A stream written as lines of text by micro-batch, read back."""
    customer = _streamed(spark, folder, "customer", "c_custkey", "c_nationkey")
    lines = BatchFolder(work_folder(spark, "stream-text"))
    run_batches(customer, "stream-text", lines.write_text)
    read = spark.read.text(lines.path).select(F.from_json("value", customer.schema).alias("row"))
    return read.select("row.*")


@query("select a.event_id as click_event_id, b.event_id as purchase_event_id " + _PAIRS_SQL)
def stream_equi(spark, folder):
    split = _user_split(spark, folder)
    on = [("click_user_id", "purchase_user_id")]
    pairs = stream_join(*_stream_clicks_purchases(spark, folder, not split.whole), on=on, split=split)
    return run_to_table(pairs.select(*_EVENT_IDS[:2]), "stream-equi")


def _user_split(spark: SparkSession, folder: str) -> Split:
    """The split of the click-purchase join, measured on the events there are."""
    return choose_split(*_clicks_purchases(spark, folder), [("click_user_id", "purchase_user_id")], "auto")


@query("select a.event_id as click_event_id, b.event_id as purchase_event_id " + _PAIRS_SQL)
def stream_equi_stored(spark, folder):
    """The same join with files instead of join state, its keys measured anew in every micro-batch."""
    on = [("click_user_id", "purchase_user_id")]
    clicks, purchases = _stream_clicks_purchases(spark, folder)
    pairs = stored_join(clicks, purchases, lambda l, r: equi_join(l, r, on), "stream-equi-stored", on=on)
    return pairs.select(*_EVENT_IDS[:2])


@query("select a.event_id as click_event_id, b.event_id as purchase_event_id " + _PAIRS_SQL)
def stream_equi_batches(spark, folder):
    """The same join over the events cut into several files that come one by one, so old rows meet new ones both ways."""
    base = work_folder(spark, "events-by-time")
    table(spark, folder, "events").repartitionByRange(4, "ts").write.parquet(f"{base}/events.parquet")
    on = [("click_user_id", "purchase_user_id")]
    clicks, purchases = _stream_clicks_purchases(spark, base, max_files=1)
    pairs = stored_join(clicks, purchases, lambda l, r: equi_join(l, r, on), "stream-equi-batches", on=on, parts=8, fan=2)
    return pairs.select(*_EVENT_IDS[:2])


@query("select a.event_id as click_event_id, b.event_id as purchase_event_id " + _ORDERED_SQL)
def stream_ordered_equi(spark, folder):
    split = _user_split(spark, folder)
    pairs = _ordered(*_stream_clicks_purchases(spark, folder, not split.whole), split=split)
    return run_to_table(pairs.select(*_EVENT_IDS[:2]), "stream-ordered")


@query(_LT_SQL)
def stream_theta(spark, folder):
    shape = _grid(_nations(spark, folder), _suppliers(spark, folder))
    nations = _streamed_rows(spark, folder, "nation", "n_nationkey")
    suppliers = _streamed_rows(spark, folder, "supplier", "s_suppkey")
    pairs = stream_join(nations, suppliers, "cross", predicate=_less, split=shape)
    return run_to_table(pairs.select("n_nationkey", "s_suppkey"), "stream-theta")


@query(_LT_SQL)
def stream_theta_stored(spark, folder):
    nations = _streamed(spark, folder, "nation", "n_nationkey")
    suppliers = _streamed(spark, folder, "supplier", "s_suppkey")
    return stored_theta_join(nations, suppliers, _less, "stream-theta-stored")


@query(f"select r_regionkey, n_nationkey, s_suppkey {_CHAIN_SQL}")
def stream_lt_chain(spark, folder):
    first = _grid(_regions(spark, folder), _nations(spark, folder))
    # The pairs are at most as many as the nations times the few regions; their number sets the grid.
    second = _grid(
        theta_join(_regions(spark, folder), _nations(spark, folder), lambda r, n: r.r_regionkey < n.n_nationkey),
        _suppliers(spark, folder),
    )
    regions = _streamed_rows(spark, folder, "region", "r_regionkey")
    nations = _streamed_rows(spark, folder, "nation", "n_nationkey")
    suppliers = _streamed_rows(spark, folder, "supplier", "s_suppkey")
    pairs = stream_join(
        regions, nations, "cross", predicate=lambda r, n: r.r_regionkey < n.n_nationkey, split=first
    )
    triples = stream_join(pairs, suppliers, "cross", predicate=_less, split=second)
    return run_to_table(triples.select("r_regionkey", "n_nationkey", "s_suppkey"), "stream-lt-chain")


@query("select n_nationkey, s_suppkey from nation cross join supplier")
def stream_cross(spark, folder):
    shape = _grid(_nations(spark, folder), _suppliers(spark, folder))
    nations = _streamed_rows(spark, folder, "nation", "n_nationkey")
    suppliers = _streamed_rows(spark, folder, "supplier", "s_suppkey")
    pairs = stream_join(nations, suppliers, "cross", split=shape)
    return run_to_table(pairs.select("n_nationkey", "s_suppkey"), "stream-cross")


def _chain_inputs(spark: SparkSession, folder: str, *names: str) -> tuple[list[DataFrame], tpch.ChainSplits, Run]:
    """The streams of a chain, its splits, and how to run it: with as many partitions as the tables have bytes for, or as
    there are cores."""
    at_rest = _chain_keys(spark, folder, *names)
    splits = tpch.chain_splits(*at_rest)
    streams = [
        _streamed_rows(spark, folder, name, *_CHAIN_COLUMNS[name])
        if splits.any
        else _streamed(spark, folder, name, *_CHAIN_COLUMNS[name])
        for name in names
    ]
    return streams, splits, Run(partitions=max(state_partitions(*at_rest), parallelism(at_rest[0])))


def _run_chain(streams: list[DataFrame], chain: Callable[..., DataFrame], columns: tuple[str, ...], name: str, run: Run) -> DataFrame:
    """The columns of a chain over streams, its intermediate relations stored."""
    return stored_chain(streams, lambda *tables, join: chain(*tables, join=join).select(*columns), name, run)


@query(f"select {', '.join(_Q3_KEYS)} {_Q3_FROM}")
def stream_q3(spark, folder):
    streams, splits, run = _chain_inputs(spark, folder, *_Q3_TABLES)
    chain = partial(tpch.q3_chain, splits=splits)
    return _run_chain(streams, chain, _Q3_KEYS, "stream-q3", run)


@query(f"select {', '.join(_Q3_KEYS)}, true as in_time {_Q3_FROM}")
def stream_q3_times(spark, folder):
    """The same with the times at which the pair and the result came out, of which only their order is fixed."""
    streams, splits, run = _chain_inputs(spark, folder, *_Q3_TABLES)
    chain = partial(tpch.q3_chain, splits=splits, stamps=True)
    found = _run_chain(streams, chain, (*_Q3_KEYS, "pair_ts", "emit_ts"), "stream-q3-times", run)
    return found.select(*_Q3_KEYS, F.coalesce(F.col("pair_ts") <= F.col("emit_ts"), F.lit(False)).alias("in_time"))


@query(
    """select c_custkey, o_orderkey, s_suppkey, s_nationkey from customer join orders on c_custkey = o_custkey
    join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey"""
)
def stream_q5_cols(spark, folder):
    streams, splits, run = _chain_inputs(spark, folder, *_Q5_TABLES[:4])
    chain = partial(tpch.q5_chain, splits=splits)
    return _run_chain(streams, chain, ("c_custkey", "o_orderkey", "s_suppkey", "s_nationkey"), "stream-q5-cols", run)


@query(f"select {', '.join(_Q5_KEYS)} {_Q5_FROM}")
def stream_q5(spark, folder):
    streams, splits, run = _chain_inputs(spark, folder, *_Q5_TABLES)
    chain = partial(tpch.q5_chain, splits=splits)
    return _run_chain(streams, chain, _Q5_KEYS, "stream-q5", run)


# Micro-batches that the streams bounded in time are cut into.
_SLICES = 5
# An inner join has nothing to add once all rows are read.
_NO_CLOSING = Run(closing_batch=False)


def _in_tasks(tasks: int) -> Run:
    return replace(_NO_CLOSING, partitions=tasks)


def _events_by_time(spark: SparkSession, folder: str) -> tuple[str, int]:
    """A folder with the events in several files that come in order of time, and the files that a micro-batch takes."""
    base = work_folder(spark, "events-by-time")
    in_time_order(table(spark, folder, "events"), "ts", f"{base}/events.parquet", _SLICES)
    return base, files_per_batch(table(spark, base, "events"), _SLICES)


def _timed_streams(spark: SparkSession, folder: str, *kinds: str) -> tuple[list[DataFrame], list[Split], timedelta]:
    """Events of each kind, their ids and times, as a stream in several micro-batches; the splits of the chain of their interval
    joins; and the lateness with which no row is late."""
    base, files = _events_by_time(spark, folder)
    events = table(spark, base, "events")
    first, *rest = [(_events(events, kind, f"{kind}_"), f"{kind}_ts") for kind in kinds]
    splits = bucket_splits(*first, rest, WITHIN)
    # A stream's files hold all kinds, and one delay is enough for all.
    late = measured_lateness(events.select(F.col("ts").cast("timestamp").alias("ts")), "ts")
    streams = [_stream_events(spark, base, kind, False, files).select(f"{kind}_event_id", f"{kind}_ts") for kind in kinds]
    return streams, splits, timedelta(milliseconds=int(late.split()[0]))


@query(f"select {_IDS2} {_INTERVAL_SQL}")
def stream_interval_join(spark, folder):
    (clicks, purchases), (split,), late = _timed_streams(spark, folder, "click", "purchase")
    streams = [(clicks, "click_ts"), (purchases, "purchase_ts")]
    tasks = _TASKS_PER_CORE * parallelism(clicks)
    near = lambda *tables: _near(*tables, split=split, tasks=tasks).select(*_EVENT_IDS[:2])
    return stored_interval_join(streams, near, WITHIN, late, "stream-interval", _in_tasks(tasks))


@query(f"select {_IDS3} {_INTERVAL3_SQL}")
def stream_interval_join3(spark, folder):
    (clicks, purchases, views), splits, late = _timed_streams(spark, folder, "click", "purchase", "view")
    streams = [(clicks, "click_ts"), (purchases, "purchase_ts"), (views, "view_ts")]
    run = _in_tasks(_TASKS_PER_CORE * parallelism(clicks))
    near = partial(_near_lists, splits=splits)
    return stored_interval_join(streams, near, WITHIN, late, "stream-interval3", run, lists=_EVENT_IDS[1:])


@query(_WINDOW_SQL)
def stream_window_count(spark, folder):
    base, files = _events_by_time(spark, folder)
    timed = lambda df: df.select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    late = measured_lateness(timed(table(spark, base, "events")), "ts")
    events = timed(table_stream(spark, base, "events", max_files=files))
    return stream_window_counts(events, "ts", ["event_type"], "10 minutes", "5 minutes", late, "stream-window-count", _NO_CLOSING)


@query(
    """select count(*) as size,
    (epoch_us(max(greatest(a.ts, b.ts))) - epoch_us(min(least(a.ts, b.ts)))) // 1000 as latency_ms """
    + _PAIRS_SQL
)
def batch_stats(spark, folder):
    """Size and span, in event time, of the pairs of a stream, put together from what was observed as each micro-batch was written."""
    on = [("click_user_id", "purchase_user_id")]
    split = _user_split(spark, folder)
    pairs = stream_join(*_stream_clicks_purchases(spark, folder, not split.whole), on=on, split=split)
    reports = work_folder(spark, "batch-stats")
    pairs = observed(pairs, "pairs", F.least("click_ts", "purchase_ts"), F.greatest("click_ts", "purchase_ts"))
    run_to_table(pairs, "batch-stats-rows", Run(reports=reports))
    return run_report(observed_reports(spark, reports, "pairs"))


def _progress(spark: SparkSession, folder: str) -> DataFrame:
    """Progress of a streaming join of customers and orders."""
    customer = _streamed(spark, folder, "customer", "c_custkey")
    orders = _streamed(spark, folder, "orders", "o_orderkey", "o_custkey")
    pairs = stream_join(customer, orders, on=[("c_custkey", "o_custkey")])
    base = work_folder(spark, "progress")
    rows = BatchFolder(f"{base}/rows")
    run_batches(pairs, "progress", rows.write, Run(reports=f"{base}/reports"), folder=base)
    return progress_table(spark, f"{base}/reports")


# Durations and rates: all but the counts of rows.
_MEASURES = [c for c in PROGRESS_COLUMNS if not c.startswith("numInputRows")]


@query(
    """select (select count(*) from customer) + (select count(*) from orders) as "numInputRows",
    (select count(*) from customer) as "numInputRowsA", (select count(*) from orders) as "numInputRowsB", """
    + ", ".join(f'true as "{c}"' for c in _MEASURES)
)
def progress_flatten(spark, folder):
    """The flat table, of each count its sum and of each measure, which the clock decides, whether all are there and sound."""
    return _progress(spark, folder).agg(
        *[F.sum(c).alias(c) for c in PROGRESS_COLUMNS if c not in _MEASURES],
        *[F.every(F.coalesce(F.col(c) >= 0, F.lit(False))).alias(c) for c in _MEASURES],
    )


@query(
    """select (select count(*) from customer) + (select count(*) from orders) as rows_in,
    (select count(*) from customer) as rows_in_a, (select count(*) from orders) as rows_in_b"""
)
def progress_rows(spark, folder):
    """Rows read, over all micro-batches: the part of the progress reports that does not depend on the clock."""
    return _progress(spark, folder).agg(
        F.sum("numInputRows").alias("rows_in"),
        F.sum("numInputRowsA").alias("rows_in_a"),
        F.sum("numInputRowsB").alias("rows_in_b"),
    )
