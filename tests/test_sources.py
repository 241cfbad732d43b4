"""Sources, generators, expressions and reports."""

import json

import pytest
from conftest import SMALL, bag, plan
from pyspark.sql import functions as F

from conflux.functions import csv_line, row_message, split_field, stamped
from conflux.session import work_folder
from conflux.sources import (
    TPCH,
    delimited_table,
    int_relation,
    kafka_options,
    message_text,
    random_key,
    random_keys,
    table,
    table_stream,
)
from conflux.streaming import PROGRESS_COLUMNS, Run, progress_table, run_to_table

SUPPLIERS = """1|Supplier#1|"one" street|17|27-918-335-1736|5755.94|each slyly|
2|Supplier#2|two street|5|15-679-861-2259|-4032.68|slyly bold|
"""


@pytest.fixture
def suppliers(tmp_path):
    path = tmp_path / "supplier.tbl"
    path.write_text(SUPPLIERS)
    return str(path)


def test_delimited_table(spark, suppliers):
    df = delimited_table(spark, suppliers, TPCH["supplier"])
    assert len(df.columns) == 7
    assert [r["s_address"] for r in df.orderBy("s_suppkey").collect()] == ['"one" street', "two street"]
    keys = delimited_table(spark, suppliers, TPCH["supplier"], ["s_suppkey", "s_nationkey"])
    assert [tuple(r) for r in keys.orderBy("s_suppkey").collect()] == [(1, 17), (2, 5)]
    assert "ReadSchema: struct<s_suppkey:int,s_nationkey:int>" in plan(keys)


def test_delimited_table_without_closing_bar(spark, tmp_path):
    (tmp_path / "x.tbl").write_text("1|a\n2|b\n")
    df = delimited_table(spark, str(tmp_path / "x.tbl"), "k int, v string", closed=False)
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1, "a"), (2, "b")]


def test_bad_numbers_fail(spark, tmp_path):
    (tmp_path / "x.tbl").write_text("1|a|\nx|b|\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        delimited_table(spark, str(tmp_path / "x.tbl"), "k int, v string").collect()
    lines = spark.read.text(str(tmp_path / "x.tbl"))
    with pytest.raises(Exception, match="is no int"):
        lines.select(split_field(F.col("value"), 0)).collect()
    with pytest.raises(Exception, match="is no int"):
        lines.select(split_field(F.col("value"), 9)).collect()


@pytest.mark.parametrize("name", sorted(TPCH))
def test_schemas_parse(spark, name):
    df = spark.createDataFrame([], TPCH[name])
    assert df.columns[0] == name[0] + {"orders": "_orderkey", "lineitem": "_orderkey"}.get(
        name, {"supplier": "_suppkey", "customer": "_custkey"}.get(name, f"_{name}key")
    )


def test_int_relation_keeps_copies_and_is_stamped(spark, tmp_path):
    (tmp_path / "rel.txt").write_text("5\n7\n5\n")
    df = int_relation(spark, str(tmp_path / "rel.txt"), "k")
    assert sorted(r["k"] for r in df.collect()) == [5, 5, 7]
    assert df.schema["arrival_ts"].dataType.typeName() == "timestamp"
    stream = int_relation(spark, str(tmp_path), "k", stream=True, max_files=1)
    assert sorted(r["k"] for r in run_to_table(stream, "t", Run(partitions=1)).collect()) == [5, 5, 7]


def test_random_keys(spark):
    df = random_keys(spark, 2000, -3, 4, seed=5)
    assert df.count() == 2000
    assert {r["key"] for r in df.distinct().collect()} == set(range(-3, 4))
    assert bag(df) == bag(random_keys(spark, 2000, -3, 4, seed=5))
    with pytest.raises(ValueError):
        random_keys(spark, 1, 4, 4)
    for number, key in ((0, 0), (1, 1), (2, 2), (1999, 1999)):
        assert random_keys(spark, 2000, 0, 1000, seed=9).collect()[number]["key"] == plain_key(key, 0, 1000, 9)


def plain_key(number, start, end, seed):
    """The rounds in whole numbers of any size."""

    def mixed(x):
        for factor, shift in ((0x7FEB352D, 16), (0x2C1B3C6D, 15)):
            x = (x ^ x >> shift) * factor % 2**32
        return x ^ x >> 16

    word = mixed(mixed(number % 2**32 ^ mixed(seed)) ^ number >> 32)
    return (word * (end - start) >> 32) + start


def test_random_keys_depend_on_the_row_only(spark):
    rows = [0, 1, 77, 2**31, 2**32 - 1, 2**32, 2**32 + 1, 2**40 + 5, 2**62]
    df = spark.createDataFrame([(n,) for n in rows], "n long")
    for parts in (1, 3, 7):
        for start, end, seed in ((0, 10, 42), (-5, 2**31 - 6, 0), (1, 2, 7)):
            got = {r["n"]: r["k"] for r in df.repartition(parts).select("n", random_key(F.col("n"), start, end, seed).alias("k")).collect()}
            assert got == {n: plain_key(n, start, end, seed) for n in rows}
    counts = random_keys(spark, 70_000, 0, 7, seed=1).groupBy("key").count()
    assert counts.where("abs(count - 10000) > 400").isEmpty() and counts.count() == 7
    both = random_keys(spark, 70_000, 0, 7, 1).toDF("a").withColumn("i", F.monotonically_increasing_id())
    other = random_keys(spark, 70_000, 0, 7, 2).toDF("b").withColumn("i", F.monotonically_increasing_id())
    assert 0.12 < both.join(other, "i").where("a = b").count() / 70_000 < 0.165


def test_kafka_options():
    assert kafka_options("h:1,i:2", ["a", "b"], "g", earliest=True, max_offsets=9) == {
        "kafka.bootstrap.servers": "h:1,i:2",
        "subscribe": "a,b",
        "startingOffsets": "earliest",
        "kafka.group.id": "g",
        "maxOffsetsPerTrigger": "9",
    }
    assert kafka_options("h:1", ["a"])["startingOffsets"] == "latest"


def test_kafka_messages_are_decoded(spark):
    schema = "key binary, value binary, topic string, partition int, offset bigint"
    messages = spark.createDataFrame([(None, b"12|3|", "t", 0, 1), (None, b"12|3|", "t", 0, 2)], schema)
    df = message_text(messages, row_id="id")
    assert [r["value"] for r in df.collect()] == ["12|3|", "12|3|"]
    assert df.select("id").distinct().count() == 2
    assert df.select(split_field(F.col("value"), 1).alias("x")).first()["x"] == 3


def test_row_message(spark):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "k int, v string")
    assert [tuple(r) for r in row_message(df).collect()] == [("1,a|b", '{"k":1,"v":"a|b"}'), ("2", '{"k":2}')]
    assert df.select(csv_line(F.lit(10), F.lit(3), F.lit(2.5)).alias("x")).first()["x"] == "10,3,2.5"


def test_stamp_is_one_instant(spark):
    assert stamped(spark.range(1000).repartition(4)).select("arrival_ts").distinct().count() == 1


def test_table_stream_reads_only_the_columns_used_and_numbers_rows(spark):
    stream = table_stream(spark, SMALL, "orders", row_id="row")
    result = run_to_table(stream.select("o_orderkey", "row"), "t", Run(partitions=1))
    assert bag(result.select("o_orderkey")) == bag(table(spark, SMALL, "orders").select("o_orderkey"))
    assert result.select("row").distinct().count() == result.count()


def test_table_stream_of_a_folder(spark, tmp_path):
    orders = table(spark, SMALL, "orders").select("o_orderkey")
    orders.repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    result = run_to_table(table_stream(spark, str(tmp_path), "orders", max_files=1), "t", Run(partitions=1))
    assert bag(result) == bag(orders)


def report(offsets, two_sources=True):
    source = {"numInputRows": 4, "processedRowsPerSecond": 2.0, "description": "x"}
    durations = {"addBatch": 1, "getBatch": 2, "queryPlanning": 4, "triggerExecution": 5, "walCommit": 6}
    return json.dumps(
        {
            "numInputRows": 7,
            "processedRowsPerSecond": 3.5,
            "durationMs": {**durations, offsets: 3},
            "sources": [source, {**source, "numInputRows": 3}] if two_sources else [source],
        }
    )


def test_progress_table(spark, tmp_path):
    lines = [report("getOffset"), report("latestOffset"), report("latestOffset", False)]
    (tmp_path / "p.json").write_text("\n".join(lines))
    df = progress_table(spark, str(tmp_path))
    assert df.columns == PROGRESS_COLUMNS
    full = (7, 3.5, 1, 2, 3, 4, 5, 6, 4, 2.0, 3, 2.0)
    assert sorted(map(tuple, df.collect()), key=str) == sorted([full, full, full[:10] + (None, None)], key=str)


def test_work_folder_is_under_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    first, second = work_folder(spark, "x"), work_folder(spark, "x")
    assert first != second
    assert shared is None or first.startswith(shared)
