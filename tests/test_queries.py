"""Every registered query gives the rows of its SQL."""

from collections import Counter

import duckdb
import pytest
from conftest import SMALL, bag, settings

import __spark_entry__ as entry_points
from conflux.operators import split
from conflux.plans.catalog import QUERIES as CATALOGUE

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def check(spark, db, name):
    df = entry_points.queries()[name](spark, SMALL)
    if name not in entry_points.oracle_sql():
        assert df.count() > 0
        return
    result = db.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    expected = Counter(tuple(row[i] for i in order) for row in result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert bag(df) == expected


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query_matches_sql(spark, db, name):
    check(spark, db, name)


LARGE = """equi_join ordered_equi interval_join interval_join3 q3_topk q3_join_count q5_join_count theta_ge
    auto_side_theta lt_chain_triples cross_join stream_equi stream_equi_stored stream_q3 stream_q5
    stream_interval_join3 stream_theta_stored batch_stats""".split()


@pytest.mark.parametrize("name", LARGE)
def test_query_matches_sql_as_if_tables_were_large(spark, db, name, monkeypatch):
    """Nothing is small enough to be broadcast, and a handful of rows of a key are too many for a cell."""
    rows = 1 if name == "q3_topk" or "interval" in name else 5
    monkeypatch.setattr("conflux.operators.split.MIN_ROWS_PER_CELL", rows)
    for module in ("split", "interval"):
        monkeypatch.setattr(f"conflux.operators.{module}.parallelism", lambda df: 1000)
    splits = []
    meet = split.meet

    def watched(left, right, on, condition, split, *ids):
        splits.append(split)
        return meet(left, right, on, condition, split, *ids)

    for module in ("equi", "interval", "theta"):
        monkeypatch.setattr(f"conflux.operators.{module}.meet", watched)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        check(spark, db, name)
    assert any(not s.whole for s in splits)


def test_every_sql_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
