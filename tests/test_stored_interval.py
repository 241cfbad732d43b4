"""Joins in time of streams that keep the rows they still need as files."""

from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from conftest import bag, cut_in_files
from pyspark.sql import functions as F

from conflux.operators import Split, interval, interval_chain, interval_join
from conflux.plans.catalog import QUERIES
from conflux.sources import file_stream
from conflux.streaming import BatchFolder, run
from conflux.streaming.joins import stored_interval_join

WITHIN = timedelta(minutes=10)


def _stamped(spark, seconds, name):
    """Rows with a number and a time; every time twice, and rows without one."""
    at = F.timestamp_seconds(F.col("s")).alias(f"{name}_ts")
    df = spark.createDataFrame([(i, None if s is None else s) for i, s in enumerate([*seconds, *seconds, None, None])], f"{name} int, s long")
    return df.select(name, at)


def _streams(spark, folder, tables, files, order):
    """Each table as a stream of one file for each micro-batch, in the order of a column, or as the rows come."""
    made = []
    for df in tables:
        path = cut_in_files(df, folder / df.columns[0], files, order(df))
        made.append((file_stream(spark, path, df.schema, max_files=1), df.columns[1]))
    return made


def _chain(splits):
    return lambda a, b, c: interval_chain(a, "a_ts", [(b, "b_ts"), (c, "c_ts")], WITHIN, splits, tasks=6)


@pytest.mark.parametrize("split", [Split(), Split(2, 3)])
def test_pairs_over_batches_in_order_are_found_once_and_old_rows_dropped(spark, tmp_path, split):
    a, b = _stamped(spark, range(0, 30000, 130), "a"), _stamped(spark, range(50, 30000, 170), "b")
    join = lambda l, r: interval_join(l, r, "a_ts", "b_ts", WITHIN, split=split, tasks=6)
    streams = _streams(spark, tmp_path, (a, b), 8, lambda df: df.columns[1])
    found = stored_interval_join(streams, join, WITHIN, timedelta(minutes=1), "t", folder=f"{tmp_path}/kept")
    expected = interval_join(a, b, "a_ts", "b_ts", WITHIN, split=None)
    assert bag(found) == bag(expected) and found.count() > 1000
    last = max(int(p.name) for p in Path(f"{tmp_path}/kept/kept/old").iterdir())
    assert last >= 7
    kept = spark.read.parquet(f"{tmp_path}/kept/kept/old/{last}").count()
    assert 0 < kept < 0.3 * (a.count() + b.count())
    assert len(list(Path(f"{tmp_path}/kept/kept/new").iterdir())) <= 2


@pytest.mark.parametrize("splits", [[Split(), Split()], [Split(), Split(2, 1)]])
def test_triples_over_batches_out_of_order_are_found_once(spark, tmp_path, splits):
    """New rows meet old ones of each other table, and of two at a time; the second two files go over the same times again."""
    tables = [_stamped(spark, range(s, 9000, step), n) for s, step, n in ((0, 170, "a"), (60, 400, "b"), (9, 500, "c"))]
    streams = _streams(spark, tmp_path, tables, 4, lambda df: None)
    found = stored_interval_join(streams, _chain(splits), WITHIN, timedelta(hours=3), "t")
    expected = interval_chain(tables[0], "a_ts", [(tables[1], "b_ts"), (tables[2], "c_ts")], WITHIN, [None, None])
    assert bag(found) == bag(expected) and found.count() > 1000


def test_triples_of_rows_twice_the_interval_apart(spark, tmp_path):
    """The first table's row comes last, and is near both others, which are not near each other."""
    one = lambda name, *seconds: spark.createDataFrame([(s,) for s in seconds], "s long").select(
        F.col("s").alias(name), F.timestamp_seconds("s").alias(f"{name}_ts")
    )
    tables = [one("a", 0, 600, 1201), one("b", 0, 3, 1200), one("c", 0, 1199, 1200)]
    streams = _streams(spark, tmp_path, tables, 3, lambda df: df.columns[0])
    found = stored_interval_join(streams, _chain([Split(), Split()]), WITHIN, timedelta(seconds=1), "t")
    expected = interval_chain(tables[0], "a_ts", [(tables[1], "b_ts"), (tables[2], "c_ts")], WITHIN, [None, None])
    assert bag(found) == bag(expected)
    assert found.where("a = 600 and b = 0 and c = 1200").count() == 1


def test_a_run_goes_on_from_its_folder(spark, tmp_path):
    a, b = _stamped(spark, range(0, 9000, 130), "a"), _stamped(spark, range(50, 9000, 170), "b")
    join = lambda l, r: interval_join(l, r, "a_ts", "b_ts", WITHIN, split=Split())
    for part in ("a < 40", "a >= 40"):
        for df in (a, b):
            name = df.columns[0]
            cut_in_files(df.where(part.replace("a", name)), tmp_path / name, 2)
        streams = [(file_stream(spark, str(tmp_path / df.columns[0]), df.schema, max_files=1), df.columns[1]) for df in (a, b)]
        found = stored_interval_join(streams, join, WITHIN, timedelta(hours=3), "t", folder=f"{tmp_path}/kept")
    assert bag(found) == bag(interval_join(a, b, "a_ts", "b_ts", WITHIN, split=None))


@pytest.mark.parametrize("split", [Split(), Split(2, 2)])
def test_few_bytes_that_give_many_pairs_are_joined_in_many_tasks(spark, split):
    """Also where a side is broadcast, whichever it is."""
    few, many = _stamped(spark, range(0, 90000, 900), "a").coalesce(1), _stamped(spark, range(0, 90000, 60), "b").coalesce(1)
    for l, r in ((few, many), (many, few)):
        found = interval_join(l, r, l.columns[1], r.columns[1], WITHIN, split=split, tasks=6)
        plain = interval_join(l, r, l.columns[1], r.columns[1], WITHIN, split=None)
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        assert bag(found) == bag(plain)


@pytest.mark.parametrize("name", ["stream_interval_join", "stream_interval_join3"])
def test_no_event_or_pair_is_kept_one_by_one(spark, monkeypatch, tmp_path, name):
    """No join state: its cost for each pair is what the large tables failed by."""
    kinds, start = ("click", "purchase", "view", "error"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(i, start + timedelta(seconds=97 * i), i % 7, kinds[i % 4]) for i in range(600)]
    rows += [(9001, None, 1, "click"), (9002, None, 1, "purchase"), (9003, None, 1, "view")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    states = []
    finish = run.finish

    def watched(query, how):
        done = finish(query, how)
        states.extend(s for p in done.recentProgress for s in p["stateOperators"])
        return done

    monkeypatch.setattr(run, "finish", watched)
    found, plain = QUERIES[name](spark, str(tmp_path)), QUERIES[name.removeprefix("stream_")](spark, str(tmp_path))
    assert bag(found) == bag(plain) and found.count() > 300
    assert not states


@pytest.mark.parametrize("first", ["none", "one", "other"])
def test_streams_whose_first_batches_have_no_rows(spark, tmp_path, first):
    """Nothing is dropped as long as a stream has no row with a time, also where none has any."""
    none = lambda name: spark.createDataFrame([(-1, None)], f"{name} int, {name}_ts timestamp")
    tables, streams = [], []
    for name, step, late in (("a", 130, first != "one"), ("b", 170, first != "other")):
        df, path = _stamped(spark, range(0, 30000, step), name), tmp_path / name
        for _ in range(2 if late else 0):
            none(name).coalesce(1).write.mode("append").parquet(str(path))
        cut_in_files(df, path, 5, df.columns[1])
        tables.append(df)
        streams.append((file_stream(spark, str(path), df.schema, max_files=1), df.columns[1]))
    join = lambda l, r: interval_join(l, r, "a_ts", "b_ts", WITHIN, split=Split())
    found = stored_interval_join(streams, join, WITHIN, timedelta(hours=3), "t", folder=f"{tmp_path}/kept")
    assert bag(found) == bag(interval_join(*tables, "a_ts", "b_ts", WITHIN, split=None)) and found.count() > 1000


@pytest.mark.parametrize("name", ["stream_interval_join", "stream_interval_join3"])
def test_events_of_a_kind_may_come_after_the_first_batches(spark, tmp_path, name):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    kind = lambda i: "view" if i < 300 else ("click", "purchase", "view")[i % 3]
    rows = [(i, start + timedelta(seconds=97 * i), i % 7, kind(i)) for i in range(900)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    found, plain = QUERIES[name](spark, str(tmp_path)), QUERIES[name.removeprefix("stream_")](spark, str(tmp_path))
    assert bag(found) == bag(plain) and found.count() > 300


def _listed(a, others, splits, **options):
    found = interval_chain(a, "a_ts", others, WITHIN, splits, lists=["bs", "cs"], **options)
    return found, interval.multiplied(found, ["bs", "cs"]).select("a", "a_ts", "bs.*", "cs.*")


@pytest.mark.parametrize("list_rows", [4096, 3])
@pytest.mark.parametrize("splits", [[Split(), Split()], [Split(2, 3), Split(1, 2)], None])
def test_lists_of_near_rows_have_each_combination_once(spark, no_broadcast, monkeypatch, list_rows, splits):
    """Also where a bucket has several lists of a table, is dealt over cells, or has rows of one time or none."""
    monkeypatch.setattr(interval, "LIST_ROWS", list_rows)
    a, b = _stamped(spark, [*range(0, 9000, 170), *[77] * 5], "a"), _stamped(spark, [*range(60, 9000, 400), *[80] * 9], "b")
    c = _stamped(spark, [*range(9, 3000, 500), 7000], "c")
    others = [(b, "b_ts"), (c, "c_ts")]
    expected = bag(interval_chain(a, "a_ts", others, WITHIN, [None, None]))
    for options in ({}, {"tasks": 6}, {"ids": [["a"], ["b"], ["c"]]}):
        found, rows = _listed(a, others, splits, **options)
        assert bag(rows) == expected and sum(expected.values()) > 1000
        assert max(found.agg(F.max(F.size("bs")), F.max(F.size("cs"))).first()) <= (4096 if list_rows == 4096 else 30)
        assert found.where("size(bs) = 0 or size(cs) = 0").isEmpty()


def test_lists_of_a_busy_bucket_are_short(spark, monkeypatch):
    monkeypatch.setattr(interval, "LIST_ROWS", 50)
    a, b, c = _stamped(spark, [5], "a"), _stamped(spark, range(1000), "b"), _stamped(spark, [6], "c")
    found, rows = _listed(a, [(b, "b_ts"), (c, "c_ts")], [Split(), Split()])
    assert rows.count() == 2 * 1212 * 2
    assert found.agg(F.max(F.size("bs"))).first()[0] < 200


def test_the_lists_of_one_row_have_no_more_combinations_than_a_task_can_hold(spark):
    a, b, c = (_stamped(spark, [5] * n, name) for n, name in ((1, "a"), (1500, "b"), (1500, "c")))
    found, rows = _listed(a, [(b, "b_ts"), (c, "c_ts")], [Split(), Split()])
    assert rows.count() == 2 * 3000 * 3000
    assert found.agg(F.max(F.size("bs") * F.size("cs"))).first()[0] < 2_000_000


def test_streams_have_no_lists(spark, tmp_path):
    a, b = _stamped(spark, [5], "a"), _stamped(spark, [5], "b")
    (s, _), = _streams(spark, tmp_path, [a], 1, lambda df: None)
    with pytest.raises(ValueError, match="lists"):
        interval_chain(s, "a_ts", [(b, "b_ts")], WITHIN, [Split()], lists=["bs"])


def test_lists_over_batches_out_of_order_give_each_triple_once(spark, tmp_path):
    tables = [_stamped(spark, range(s, 9000, step), n) for s, step, n in ((0, 170, "a"), (60, 400, "b"), (9, 500, "c"))]
    others = [(tables[1], "b_ts"), (tables[2], "c_ts")]
    streams = _streams(spark, tmp_path, tables, 4, lambda df: None)
    join = lambda a, b, c: interval_chain(
        a, "a_ts", [(b, "b_ts"), (c, "c_ts")], WITHIN, [Split(), Split()], tasks=6, lists=["bs", "cs"]
    )
    found = stored_interval_join(streams, join, WITHIN, timedelta(hours=3), "t", lists=["bs", "cs"])
    expected = interval_chain(tables[0], "a_ts", others, WITHIN, [None, None])
    assert bag(found.select("a", "a_ts", "bs.*", "cs.*")) == bag(expected) and found.count() > 1000


def test_the_stream_of_triples_writes_far_fewer_rows_than_there_are_triples(spark, monkeypatch, tmp_path):
    """Triples grow with the cube of the events, which is what the large tables failed by."""
    kinds, start = ("click", "purchase", "view"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(i, start + timedelta(seconds=20 * i), i % 7, kinds[i % 3]) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    written, write = [], BatchFolder.write

    def watched(folder, df, batch_id):
        write(folder, df, batch_id)
        written.append(df.sparkSession.read.parquet(f"{folder.path}/batch_id={batch_id}").count())

    monkeypatch.setattr(BatchFolder, "write", watched)
    found, plain = (QUERIES[name](spark, str(tmp_path)) for name in ("stream_interval_join3", "interval_join3"))
    assert bag(found) == bag(plain)
    assert found.count() > 50 * sum(written) > 0


def test_triples_of_tables_are_multiplied_out_after_the_joins(spark, no_broadcast, monkeypatch, tmp_path):
    """The joins find far fewer rows than there are triples: their time for each triple is what the large tables failed by."""
    kinds, start = ("click", "purchase", "view"), datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(i, start + timedelta(seconds=20 * i), i % 7, kinds[i % 3]) for i in range(600)]
    rows += [*rows, (9001, None, 1, "click"), (9002, None, 1, "purchase"), (9003, None, 1, "view")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    joined = []

    def watched(df, lists):
        joined.append(df.count())
        return interval.multiplied(df, lists)

    monkeypatch.setattr("conflux.plans.catalog.multiplied", watched, raising=False)
    found = QUERIES["interval_join3"](spark, str(tmp_path))
    near = lambda i, j: abs(i - j) * 20 <= 600
    ids = {kind: [i for i in range(600) if kinds[i % 3] == kind] for kind in kinds}
    expected = {
        (a, b, c): 8 for a in ids["click"] for b in ids["purchase"] if near(a, b) for c in ids["view"] if near(a, c)
    }
    assert found.columns == ["click_event_id", "purchase_event_id", "view_event_id"]
    assert bag(found) == expected
    assert len(joined) == 1 and found.count() > 50 * joined[0] > 0
