"""Chains of joins of streams that keep their state as files."""

from collections import Counter

import pytest
from conftest import bag, cut_in_files

from conflux.operators import Split, equi_join
from conflux.plans import tpch
from conflux.plans.catalog import QUERIES
from conflux.sources import file_stream
from conflux.streaming import run
from conflux.streaming.joins import stored_chain


def _relations(spark):
    """Rows with keys that come early and late, several times, never, and null."""
    some = lambda n, by: None if n % 11 == 0 else n % by
    customer = spark.createDataFrame([(some(i, 9),) for i in range(1, 24)], "c_custkey long")
    orders = spark.createDataFrame([(some(i, 17), some(3 * i, 13)) for i in range(1, 40)], "o_orderkey long, o_custkey long")
    items = spark.createDataFrame([(some(7 * i, 19), some(i, 5)) for i in range(1, 60)], "l_orderkey long, l_suppkey long")
    return customer, orders, items


@pytest.mark.parametrize("splits", [tpch.ChainSplits(), tpch.ChainSplits(orders_lineitem=Split(2, 2))])
def test_stored_chain_over_batches_finds_every_row_once(spark, tmp_path, splits):
    """Old rows meet new ones on both sides of both joins, and runs of batches are merged."""
    tables = _relations(spark)
    paths = [cut_in_files(df, tmp_path / f"t{i}", n) for i, (df, n) in enumerate(zip(tables, (3, 4, 5), strict=True))]
    streams = [file_stream(spark, path, df.schema, max_files=1) for path, df in zip(paths, tables, strict=True)]
    chain = lambda *dfs, join: tpch.q3_chain(*dfs, splits=splits, join=join)
    found = stored_chain(streams, chain, "t", parts=4, fan=2)
    expected = Counter(
        (c["c_custkey"], l["l_suppkey"], o["o_orderkey"])
        for c in tables[0].collect()
        for o in tables[1].collect()
        if c["c_custkey"] is not None and c["c_custkey"] == o["o_custkey"]
        for l in tables[2].collect()
        if o["o_orderkey"] is not None and o["o_orderkey"] == l["l_orderkey"]
    )
    assert bag(found.select("c_custkey", "o_orderkey", "l_suppkey")) == expected
    assert bag(found) == bag(tpch.q3_chain(*tables, join=equi_join))


@pytest.mark.parametrize("name", ["stream_q3", "stream_q3_times", "stream_q5_cols", "stream_q5"])
def test_no_row_of_a_chain_is_kept_one_by_one(spark, monkeypatch, tmp_path, name):
    """No join state: its cost for each row is what the large tables failed by."""
    made = {
        "customer": _relations(spark)[0],
        "orders": _relations(spark)[1],
        "lineitem": _relations(spark)[2],
        "supplier": spark.createDataFrame([(i, i % 3) for i in range(5)], "s_suppkey long, s_nationkey int"),
        "nation": spark.createDataFrame([(i, i % 2) for i in range(3)], "n_nationkey int, n_regionkey int"),
        "region": spark.createDataFrame([(i,) for i in range(2)], "r_regionkey int"),
    }
    for table, df in made.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    states = []
    finish = run.finish

    def watched(query, how):
        done = finish(query, how)
        states.extend(s for p in done.recentProgress for s in p["stateOperators"])
        return done

    monkeypatch.setattr(run, "finish", watched)
    found = QUERIES[name](spark, str(tmp_path))
    assert found.count() == tpch.q3_chain(*list(made.values())[:3]).where("l_suppkey is not null").count() or name.startswith("stream_q3")
    assert found.count() > 0
    assert not states
