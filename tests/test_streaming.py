"""Streams cut into several micro-batches give what the batch join gives."""

import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import SMALL, bag, cut_in_files, settings
from pyspark.sql import functions as F

from conflux.functions import stamped
from conflux.operators import Split, equi_join, interval_chain, interval_join, theta_join, window_counts
from conflux.operators.summary import run_report
from conflux.plans import tpch
from conflux.sources import file_stream, int_relation, table
from conflux.streaming import (
    BatchFolder,
    CutShort,
    Run,
    observed,
    observed_reports,
    progress_table,
    run_batches,
    run_to_console,
    run_to_table,
    store_stream,
    stored_join,
    stored_theta_join,
    stream_join,
    stream_window_counts,
)

FEW = Run(partitions=2)


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Streams of small tables, one file per micro-batch, together with the tables."""
    base = tmp_path_factory.mktemp("cut")
    made = {}

    def get(name, df, files, order=None, row_id=None):
        if name not in made:
            made[name] = cut_in_files(df, base / name, files, order)
        return file_stream(spark, made[name], df.schema, max_files=1, row_id=row_id)

    return get


def ints(spark, values, name):
    return spark.createDataFrame([(v,) for v in values], f"{name} int")


def less(l, r):
    return l.a < r.b


A, B, C = [1, 1, 2, 5, 8, 3], [2, 2, 4, 9, 0], [3, 5, 5, 10]


@pytest.mark.parametrize("split", [Split(), Split(2, 3)])
def test_equi(spark, cut, split):
    a, b = ints(spark, A, "a"), ints(spark, B + A, "b")
    found = stream_join(cut("a", a, 3), cut("ba", b, 4), on=[("a", "b")], split=split)
    result = run_to_table(found, "t", FEW)
    assert bag(result) == bag(equi_join(a, b, [("a", "b")]))


def test_equi_with_hot_key_split_off(spark, cut):
    a, b = ints(spark, [7] * 30 + A, "a"), ints(spark, [7] * 9 + B, "b")
    from conflux.operators import measure

    split = measure(a, b, [("a", "b")], rows_per_cell=5)
    assert split.heavy
    found = stream_join(
        cut("hot_a", a, 3, row_id="a_row"), cut("hot_b", b, 2, row_id="b_row"), on=[("a", "b")], split=split
    )
    result = run_to_table(found.select("a", "b"), "t", FEW)
    assert bag(result) == bag(equi_join(a, b, [("a", "b")], split=None))


@pytest.mark.parametrize("shape", [Split(1, 1), Split(2, 3), Split(1, 4)])
def test_theta_and_cross(spark, cut, shape):
    a, b = ints(spark, A, "a"), ints(spark, B, "b")
    found = stream_join(cut("a", a, 3), cut("b", b, 2), "cross", predicate=less, split=shape)
    assert bag(run_to_table(found, "t", FEW)) == bag(theta_join(a, b, less))
    crossed = stream_join(cut("a", a, 3), cut("b", b, 2), "cross", split=shape)
    assert run_to_table(crossed, "t", FEW).count() == len(A) * len(B)


def test_chain_of_inequalities(spark, cut):
    a, b, c = ints(spark, A, "a"), ints(spark, B, "b"), ints(spark, C, "c")

    def chained(x, y, z, how):
        return how(how(x, y, less), z, lambda l, r: l.b < r.c)

    grid = lambda l, r, p: stream_join(l, r, "cross", predicate=p, split=Split(2, 2))
    found = chained(cut("a", a, 3), cut("b", b, 2), cut("c", c, 2), grid)
    assert bag(run_to_table(found, "t", FEW)) == bag(chained(a, b, c, theta_join))


@pytest.mark.parametrize("side", ["auto", "grid"])
def test_stored_theta(spark, cut, side):
    a, b = ints(spark, A, "a"), ints(spark, B, "b")
    found = stored_theta_join(cut("a", a, 3), cut("b", b, 2), less, "t", FEW, side)
    assert found.columns == ["a", "b"]
    assert bag(found) == bag(theta_join(a, b, less))


def test_stored_equi(spark, cut):
    a, b = ints(spark, A, "a"), ints(spark, B + A, "b")
    on = [("a", "b")]
    found = stored_join(cut("a", a, 3), cut("ba", b, 4), lambda l, r: equi_join(l, r, on, split=Split(2, 2)), "t", FEW)
    assert bag(found) == bag(equi_join(a, b, on))


def test_stored_theta_goes_on_from_its_folder(spark, tmp_path):
    a, b = ints(spark, A, "a"), ints(spark, B, "b")
    cut_in_files(a.limit(3), tmp_path / "a", 2)
    cut_in_files(b, tmp_path / "b", 1)

    def run():
        left = file_stream(spark, str(tmp_path / "a"), a.schema, max_files=1)
        right = file_stream(spark, str(tmp_path / "b"), b.schema, max_files=1)
        return stored_theta_join(left, right, less, "t", FEW, folder=str(tmp_path / "work"))

    assert bag(run()) == bag(theta_join(a.limit(3), b, less))
    cut_in_files(a.subtract(a.limit(3)), tmp_path / "a", 1)
    more = a.limit(3).unionAll(a.subtract(a.limit(3)))
    assert bag(run()) == bag(theta_join(more, b, less))
    assert bag(run()) == bag(theta_join(more, b, less))


@pytest.mark.parametrize("spill", [True, False])
def test_restart_gives_no_row_twice(spark, tmp_path, spill):
    a, b = ints(spark, A, "a"), ints(spark, A + B, "b")
    cut_in_files(a, tmp_path / "a", 2)
    cut_in_files(b.limit(4), tmp_path / "b", 2)

    def run():
        left = file_stream(spark, str(tmp_path / "a"), a.schema, max_files=1)
        right = file_stream(spark, str(tmp_path / "b"), b.schema, max_files=1)
        pairs = stream_join(left, right, on=[("a", "b")], split=Split(2, 1))
        return run_to_table(pairs, "t", Run(partitions=2, spill=spill), str(tmp_path / "work"))

    assert bag(run()) == bag(equi_join(a, b.limit(4), [("a", "b")]))
    rest = spark.createDataFrame(b.collect()[4:], b.schema)
    cut_in_files(rest, tmp_path / "b", 2)
    assert bag(run()) == bag(equi_join(a, b, [("a", "b")]))


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    folder = BatchFolder(str(tmp_path / "store"))
    a = ints(spark, A, "a")
    for batch_id in (0, 1, 1):
        folder.write(a, batch_id)
    assert folder.read(spark, a.schema).count() == 2 * len(A)
    assert bag(folder.at(spark, a.schema, 0)) == bag(a)
    assert bag(folder.at(spark, a.schema, 1)) == bag(a)


def test_store_keeps_everything(spark, cut):
    a = ints(spark, A, "a")
    stored = store_stream(cut("a", a, 3), "t", FEW)
    assert bag(stored.select("a")) == bag(a)
    assert [r["batch_id"] for r in stored.select("batch_id").distinct().orderBy("batch_id").collect()] == [0, 1, 2]


@pytest.mark.parametrize("order", ["c_custkey", None])
def test_q3_in_any_order_of_arrival(spark, cut, order):
    customer = table(spark, SMALL, "customer").select("c_custkey").orderBy(F.desc("c_custkey")).limit(40)
    orders = table(spark, SMALL, "orders").select("o_orderkey", "o_custkey").limit(300)
    items = table(spark, SMALL, "lineitem").select("l_orderkey", "l_suppkey").limit(900)
    customer, orders, items = (spark.createDataFrame(d.collect(), d.schema) for d in (customer, orders, items))
    streams = (
        cut(f"customer{order}", customer, 3, order),
        cut("orders", orders, 2),
        cut("items", items, 1),
    )
    found = run_to_table(tpch.q3_chain(*streams, stamps=True), "t", FEW)
    expected = tpch.q3_chain(customer, orders, items, tpch.ChainSplits(Split(), Split()))
    assert bag(found.drop("pair_ts", "emit_ts")) == bag(expected)
    assert found.where("pair_ts > emit_ts").isEmpty()


def test_q5_with_split_joins(spark, cut):
    names = {
        "customer": ("c_custkey",),
        "orders": ("o_orderkey", "o_custkey"),
        "lineitem": ("l_orderkey", "l_suppkey"),
        "supplier": ("s_suppkey", "s_nationkey"),
        "nation": ("n_nationkey", "n_regionkey"),
        "region": ("r_regionkey",),
    }
    at_rest = [table(spark, SMALL, n).select(*c).limit(1500) for n, c in names.items()]
    at_rest = [spark.createDataFrame(d.collect(), d.schema) for d in at_rest]
    streams = [cut(f"q5-{n}", d, 2 if n in ("nation", "lineitem") else 1) for n, d in zip(names, at_rest)]
    splits = tpch.ChainSplits(lineitem_supplier=Split(2, 1), supplier_nation=Split(3, 1), nation_region=Split(1, 2))
    found = run_to_table(tpch.q5_chain(*streams, splits=splits), "t", FEW)
    none = tpch.ChainSplits()
    assert bag(found) == bag(tpch.q5_chain(*at_rest, splits=none))


# ---- time --------------------------------------------------------------------------------------

START = datetime(2024, 1, 1)
WITHIN = timedelta(minutes=10)


def stamps(spark, seconds, name):
    rows = [(i, START + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, f"{name}_id int, {name}_ts timestamp")


@pytest.mark.parametrize("split", [Split(), Split(2, 2)])
def test_interval_join_drops_state_but_no_pair(spark, cut, split):
    a, b = stamps(spark, range(0, 40000, 130), "a"), stamps(spark, range(50, 40000, 170), "b")
    l = cut("ia", a, 8, "a_ts").withWatermark("a_ts", "5 minutes")
    r = cut("ib", b, 8, "b_ts").withWatermark("b_ts", "5 minutes")
    rows = BatchFolder(f"{tmp(spark)}/rows")
    found = interval_join(l, r, "a_ts", "b_ts", WITHIN, split=split)
    # Counting state rows is off by default for spilled state; the other store counts them.
    done = run_batches(found, "t", rows.write, Run(partitions=2, spill=False))
    expected = interval_join(a, b, "a_ts", "b_ts", WITHIN, split=None)
    assert bag(rows.read(spark, found.schema).drop("batch_id")) == bag(expected)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in done.recentProgress]
    copies = (split.cols + 2 * split.rows) * (a.count() + b.count()) / 2
    assert len(held) >= 8 and max(held) < 0.6 * copies


def tmp(spark):
    from conflux.session import work_folder

    return work_folder(spark, "test")


def test_interval_chain(spark, cut):
    a, b, c = (stamps(spark, range(s, 9000, step), n) for s, step, n in ((0, 170, "a"), (60, 400, "b"), (9, 500, "c")))
    streams = [cut(f"c{n}", d, 4, f"{n}_ts").withWatermark(f"{n}_ts", "5 minutes") for d, n in ((a, "a"), (b, "b"), (c, "c"))]
    found = interval_chain(
        streams[0], "a_ts", [(streams[1], "b_ts"), (streams[2], "c_ts")], WITHIN, [Split(), Split(2, 1)]
    )
    expected = interval_chain(a, "a_ts", [(b, "b_ts"), (c, "c_ts")], WITHIN, [None, None])
    assert bag(run_to_table(found, "t", FEW)) == bag(expected)


@pytest.mark.parametrize("closing_batch", [True, False])
def test_interval_join_by_time_of_arrival(spark, cut, closing_batch):
    a, b = ints(spark, A, "a"), ints(spark, B, "b")
    l = stamped(cut("a", a, 3), "a_ts").withWatermark("a_ts", "1 minute")
    r = stamped(cut("b", b, 2), "b_ts").withWatermark("b_ts", "1 minute")
    found = interval_join(l, r, "a_ts", "b_ts", WITHIN, split=Split())
    result = run_to_table(found, "t", Run(partitions=2, closing_batch=closing_batch))
    assert bag(result.select("a", "b")) == bag(a.crossJoin(b))


def test_window_counts_over_batches(spark, cut):
    a = stamps(spark, range(0, 9000, 130), "a").withColumn("kind", F.col("a_id") % 2)
    stream = cut("wa", a, 4, "a_ts")
    found = stream_window_counts(stream, "a_ts", ["kind"], "10 minutes", "5 minutes", "5 minutes", "t", FEW)
    assert bag(found) == bag(window_counts(a, "a_ts", ["kind"], "10 minutes", "5 minutes"))


# ---- running -----------------------------------------------------------------------------------


def test_timeout_ends_a_periodic_run(spark, cut, tmp_path):
    a = ints(spark, A, "a")
    run = Run(every="1 second", timeout=8, partitions=2)
    result = run_to_table(cut("a", a, 3), "t", run)
    assert bag(result) == bag(a)
    assert not spark.streams.active


def test_settings_are_put_back(spark, cut):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    run_to_table(cut("a", ints(spark, A, "a"), 3), "t", Run(partitions=3))
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_every_report_is_kept_over_restarts(spark, cut, tmp_path):
    """Five micro-batches of which Spark itself would hold two reports, then a second run with what came in meanwhile."""
    a, run = ints(spark, range(50), "a"), Run(partitions=2, reports=str(tmp_path / "reports"))
    source = str(tmp_path / "in")
    a.where("a < 25").repartition(5).write.parquet(source)
    with settings(spark, **{"spark.sql.streaming.numRecentProgressUpdates": "2"}):
        for n in (5, 10):
            run_to_table(file_stream(spark, source, a.schema, max_files=1), "t", run, folder=str(tmp_path / "out"))
            found = progress_table(spark, run.reports).where("numInputRows > 0")
            assert (found.count(), found.agg(F.sum("numInputRows")).first()[0]) == (n, 5 * n)
            if n == 5:
                a.where("a >= 25").repartition(5).write.mode("append").parquet(source)


def test_streams_without_files_give_empty_results(spark, tmp_path):
    (tmp_path / "none").mkdir()
    nothing = lambda name: file_stream(spark, str(tmp_path / "none"), ints(spark, [], name).schema)
    assert store_stream(nothing("a"), "t", FEW).count() == 0
    pairs = stored_join(nothing("a"), nothing("b"), lambda l, r: equi_join(l, r, [("a", "b")]), "t", FEW)
    assert pairs.columns == ["a", "b"] and pairs.count() == 0


def test_a_run_cut_short_says_so(spark, cut):
    slow = F.udf(lambda v: time.sleep(1) or v, "int")
    stream = cut("a", ints(spark, A, "a"), 3).select(slow("a").alias("a"))
    with pytest.warns(CutShort):
        run_to_table(stream, "t", Run(timeout=2, partitions=2))


def test_stream_with_a_table_over_the_threshold(spark, cut, no_broadcast):
    a, b = ints(spark, A, "a"), ints(spark, B, "b")
    with pytest.raises(ValueError, match="shape"):
        theta_join(cut("a", a, 3), b, less)
    found = theta_join(cut("a", a, 3), b, less, shape=(2, 2))
    assert bag(run_to_table(found, "t", FEW)) == bag(theta_join(a, b, less, side="grid"))


def test_failures_come_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("1\ntwo\n")
    with pytest.raises(Exception, match="is no int"):
        run_to_table(int_relation(spark, str(tmp_path / "in"), stream=True), "t", FEW)


def test_console_and_text_sinks(spark, cut, tmp_path):
    a = ints(spark, A, "a")
    done = run_to_console(cut("a", a, 3), FEW)
    assert sum(p["numInputRows"] for p in done.recentProgress) == len(A)
    texts = BatchFolder(str(tmp_path / "text"))
    run_batches(cut("a", a, 3), "t", texts.write_text, FEW)
    lines = spark.read.text(texts.path)
    assert Counter(r["value"] for r in lines.collect()) == Counter('{"a":%d}' % v for v in A)


def test_streams_need_explicit_splits(spark, cut):
    a, b = cut("a", ints(spark, A, "a"), 3), cut("b", ints(spark, B, "b"), 2)
    with pytest.raises(ValueError, match="stream"):
        equi_join(a, b, [("a", "b")])
    with pytest.raises(ValueError, match="stream"):
        theta_join(a, b, less)
    with pytest.raises(ValueError, match="stream"):
        theta_join(a, b, less, side="grid")
    with pytest.raises(ValueError, match="equi"):
        stream_join(a, b)


def test_observed_figures_come_with_the_pass_that_writes(spark, cut, tmp_path):
    """Each micro-batch's count and ends, without reading what was written; an empty run adds nothing."""
    a, b = stamps(spark, range(0, 4000, 130), "a"), stamps(spark, range(50, 4000, 170), "b")
    l, r = cut("oa", a, 4, "a_ts"), cut("ob", b, 4, "b_ts")
    pairs = stream_join(l, r, "cross", predicate=lambda l, r: l.a_id % 5 == r.b_id % 5, split=Split(1, 2))
    run = Run(partitions=2, reports=str(tmp_path / "reports"))
    first, last = F.least("a_ts", "b_ts"), F.greatest("a_ts", "b_ts")
    for _ in range(2):
        rows = run_to_table(observed(pairs, "the pairs", first, last), "t", run, str(tmp_path / "out"))
    found = observed_reports(spark, run.reports, "the pairs").where("size > 0")
    assert found.count() == 4
    totals = rows.agg(F.count("*"), F.unix_micros(F.min(first)), F.unix_micros(F.max(last))).first()
    assert tuple(found.agg(F.sum("size"), F.min("first_us"), F.max("last_us")).first()) == tuple(totals)
    assert found.where("latency_ms <> (last_us - first_us) div 1000").isEmpty()
    whole = run_report(found).first()
    assert (whole["size"], whole["latency_ms"]) == (totals[0], (totals[2] - totals[1]) // 1000)


def test_reports_are_written_together(spark, cut, tmp_path):
    run = Run(partitions=2, reports=str(tmp_path / "reports"))
    run_to_table(cut("ra", ints(spark, range(12), "a"), 6), "t", run)
    files = list((tmp_path / "reports").glob("part-*"))
    assert len(files) == 1 and progress_table(spark, run.reports).count() >= 6


def test_a_restart_goes_on_with_its_state_partitions(spark, tmp_path):
    a, b = ints(spark, A, "a"), ints(spark, B, "b")
    cut_in_files(a, tmp_path / "a", 1)
    for n, (rows, partitions) in enumerate(((b.limit(2), 3), (b.subtract(b.limit(2)), 7))):
        cut_in_files(rows, tmp_path / "b", 1)
        streams = [file_stream(spark, str(tmp_path / name), df.schema) for name, df in (("a", a), ("b", b))]
        found = run_to_table(stream_join(*streams, on=[("a", "b")]), "t", Run(partitions=partitions), str(tmp_path / "out"))
        stores = [p.name for p in (tmp_path / "out" / "checkpoint" / "state" / "0").iterdir() if p.name.isdigit()]
        assert sorted(stores) == ["0", "1", "2"], n
    assert bag(found) == bag(equi_join(a, b.limit(2).unionAll(b.subtract(b.limit(2))), [("a", "b")]))
