"""Batch joins against brute force, whatever the grid, side or strategy."""

import operator
from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from conftest import bag, plan, settings
from hypothesis import HealthCheck, given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conflux.functions import arrow_predicate, prefixed, python_predicate
from conflux.operators import (
    Split,
    chain_summary,
    cross_join,
    equi_join,
    equi_join_summary,
    grid_join,
    grid_shape,
    inequality_join,
    interval_chain,
    interval_join,
    join_summary,
    measure,
    running_extremes,
    running_totals,
    theta_join,
)
from conflux.operators import split as split_module
from conflux.operators import theta as theta_module
from conflux.operators.interval import bucket_splits, with_bucket
from conflux.operators.split import key_hash

few = hypothesis_settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
keys = st.lists(st.one_of(st.none(), st.integers(-3, 3)), max_size=25)


def relation(spark, values, name, partitions=3):
    return spark.createDataFrame([(v,) for v in values], f"{name} int").repartition(partitions)


def pairs(left, right, test):
    return Counter((x, y) for x in left for y in right if x is not None and y is not None and test(x, y))


def test_three_by_three(spark):
    left, right = relation(spark, [1, 2, 3], "a"), relation(spark, [3, 2, 1], "b")
    found = theta_join(left, right, lambda l, r: l.a >= r.b)
    assert bag(found) == Counter([(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 3)])


@pytest.mark.parametrize("side", ["auto", "left", "right", "grid", None])
def test_theta_join_is_the_same_for_every_side(spark, side):
    left, right = [1, 1, 2, None, 5, 5, 5], [0, 1, 5, 5, None, 7]
    found = theta_join(relation(spark, left, "a"), relation(spark, right, "b"), lambda l, r: l.a < r.b, side)
    assert found.columns == ["a", "b"]
    assert bag(found) == pairs(left, right, operator.lt)


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (7, 1), (2, 3), (4, 4)])
def test_grid_shape_does_not_matter(spark, shape):
    left, right = [1, 1, 1, 2, 3], [1, 2, 2, 2, 9]
    l, r = relation(spark, left, "a"), relation(spark, right, "b")
    assert bag(grid_join(l, r, lambda x, y: x.a <= y.b, shape)) == pairs(left, right, operator.le)
    assert bag(grid_join(l, r, None, shape)) == pairs(left, right, lambda x, y: True)


@given(keys, keys, st.integers(1, 4), st.integers(1, 4))
@few
def test_split_equi_join(spark, left, right, rows, cols):
    l, r = relation(spark, left, "a"), relation(spark, right, "b")
    found = equi_join(l, r, [("a", "b")], split=Split(rows, cols))
    assert bag(found) == pairs(left, right, operator.eq)


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
@pytest.mark.parametrize("parts", [1, 2, 5])
def test_inequality_join_with_a_hot_key(spark, op, parts):
    left = [4] * 20 + list(range(10)) + [None]
    right = [4] * 15 + list(range(3, 12)) + [None]
    test = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    found = inequality_join(relation(spark, left, "a"), relation(spark, right, "b"), "a", op, "b", parts)
    assert found.columns == ["a", "b"]
    assert bag(found) == pairs(left, right, test)


@given(keys, keys, st.sampled_from(["<", ">="]), st.integers(1, 6))
@few
def test_inequality_join_on_any_keys(spark, left, right, op, parts):
    test = {"<": operator.lt, ">=": operator.ge}[op]
    found = inequality_join(relation(spark, left, "a"), relation(spark, right, "b"), "a", op, "b", parts)
    assert bag(found) == pairs(left, right, test)


@given(keys, st.integers(2, 5))
@few
def test_running_totals(spark, values, parts):
    found = running_totals(relation(spark, values, "k"), "k", {"n": F.count("k")}, parts)
    present = [v for v in values if v is not None]
    expected = Counter(
        (k, present.count(k), sum(v < k for v in present)) for k in set(present)
    )
    assert Counter((r["k"], r["n"], r["n_before"]) for r in found.collect()) == expected
    assert all(r["n_before"] + r["n"] + r["n_after"] == len(present) for r in found.collect())


def test_empty_sides(spark):
    full, empty = relation(spark, [1, 2], "a"), relation(spark, [], "b", 1)
    for side in ("auto", "left", "right", "grid", None):
        assert theta_join(full, empty, lambda l, r: l.a < r.b, side).count() == 0
        assert theta_join(empty, full, lambda l, r: l.b < r.a, side).count() == 0
    assert inequality_join(full, empty, "a", "<", "b").count() == 0
    assert cross_join(full, empty).count() == 0
    assert equi_join(full, empty, [("a", "b")], split=measure(full, empty, [("a", "b")])).count() == 0


def test_shared_names_are_refused_and_can_be_prefixed(spark):
    df = relation(spark, [1, 2], "a")
    with pytest.raises(ValueError, match="both inputs"):
        theta_join(df, df, lambda l, r: l.a < r.a)
    found = theta_join(prefixed(df, "l_"), prefixed(df, "r_"), lambda l, r: l.l_a < r.r_a)
    assert bag(found) == Counter([(1, 2)])


def test_predicate_sees_only_the_columns_of_its_side(spark):
    with pytest.raises(AttributeError, match="no column 'b'"):
        theta_join(relation(spark, [1], "a"), relation(spark, [1], "b"), lambda l, r: l.b < r.b)


def opaque(which):
    """Predicates that workers get by value, as they can't import the tests."""

    def odd(a, b):
        return (a + b) % 2 == 1

    def odd_of_arrays(a, b):
        return pa.array([None if x == 3 else (x + y) % 2 == 1 for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)])

    if which == 2:
        return arrow_predicate(odd_of_arrays, ["a"], ["b"])
    return python_predicate(odd, ["a"], ["b"], vectorized=which == 1)


@pytest.mark.parametrize("which", range(3))
@pytest.mark.parametrize("side", ["grid", "auto"])
def test_python_predicate(spark, which, side):
    left, right = list(range(12)), list(range(9))
    found = theta_join(relation(spark, left, "a"), relation(spark, right, "b"), opaque(which), side)
    assert bag(found) == pairs([a for a in left if which < 2 or a != 3], right, lambda a, b: (a + b) % 2 == 1)
    assert plan(found).count("EvalPython") == 1 and "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)


@pytest.mark.parametrize("which", range(3))
def test_a_python_predicate_needs_a_grid_or_an_equality(spark, which):
    a, b = relation(spark, range(6), "a"), relation(spark, range(6), "b")
    for side in ("left", "right", None):
        with pytest.raises(ValueError, match="grid"):
            theta_join(a, b, opaque(which), side)
    for shape in (None, (1, 1)):
        found = theta_join(a.where("a < 0"), b, opaque(which), shape=shape)
        assert found.count() == 0 and "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)
    beside = equi_join(a, b, [("a", "b")], opaque(which))
    assert beside.count() == 0 and "Cartesian" not in plan(beside)


def test_equal_sizes_keep_their_orientation(spark):
    left, right = relation(spark, [1, 2, 3], "a"), relation(spark, [1, 2, 3], "b")
    for side in ("auto", "left", "right"):
        assert bag(theta_join(left, right, lambda l, r: l.a < r.b, side)) == Counter([(1, 2), (1, 3), (2, 3)])


def test_transform(spark):
    left, right = relation(spark, [1, 2], "a"), relation(spark, [2], "b")
    assert bag(left.transform(theta_join, right, lambda l, r: l.a < r.b)) == Counter([(1, 2)])


def test_big_sides_are_not_broadcast(spark, no_broadcast, monkeypatch):
    left, right = relation(spark, range(50), "a"), relation(spark, range(40), "b")
    expected = pairs(range(50), range(40), operator.lt)
    found = theta_join(left, right, lambda l, r: l.a < r.b)
    assert "Broadcast" not in plan(found) and "Cartesian" not in plan(found)
    assert bag(found) == expected
    monkeypatch.setattr(theta_module, "HARD_BROADCAST_BYTES", 10)
    named = theta_join(left, right, lambda l, r: l.a < r.b, side="right")
    assert "Broadcast" not in plan(named)
    assert bag(named) == expected


def test_named_side_is_the_one_broadcast(spark):
    left, right = relation(spark, range(5), "a"), relation(spark, range(4), "b")
    assert "BuildLeft" in plan(theta_join(left, right, lambda l, r: l.a < r.b, "left"))
    assert "BuildRight" in plan(theta_join(left, right, lambda l, r: l.a < r.b, "right"))


def test_grid_shape():
    assert grid_shape(100, 100, 16) == (4, 4)
    assert grid_shape(1, 1_000_000, 16) == (1, 16)
    assert grid_shape(1_000_000, 1, 16) == (16, 1)
    assert grid_shape(0, 5, 16) == (1, 1)
    rows, cols = grid_shape(400, 100, 64)
    assert rows * cols >= 64 and rows > cols


# ---- hot keys ----------------------------------------------------------------------------------


def hot(spark, n, name):
    """A third of the rows share key 7, and all of those are copies of one row."""
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 100).cast("int")
    return spark.range(0, n, 1, 6).select(key.alias(name))


def test_measure_finds_the_hot_key(spark):
    left, right = hot(spark, 3000, "a"), relation(spark, range(100), "b")
    split = measure(left, right, [("a", "b")], rows_per_cell=100)
    assert (split.rows, split.cols) == (1, 1)
    assert [h[1:] for h in split.heavy] == [(11, 1)]


def test_hot_key_is_spread_and_complete(spark, no_broadcast):
    left, right = hot(spark, 3000, "a"), hot(spark, 900, "b")
    on = [("a", "b")]
    split = measure(left, right, on, rows_per_cell=100)
    expected = bag(equi_join(left, right, on, split=None).groupBy("a", "b").count())
    assert bag(equi_join(left, right, on, split=split).groupBy("a", "b").count()) == expected
    dealt = split_module._dealt(left, split, split_module.key_hash(left, ["a"]), "__cell_row", "__cell_col", None)
    cells = dealt.where("a = 7").groupBy("__cell_row", "__cell_col").count().collect()
    rows, cols = split.heavy[0][1:]
    assert len(cells) == rows * cols
    assert max(c["count"] for c in cells) < 2 * 1010 / rows


def test_dealing_is_repeatable(spark):
    left = hot(spark, 600, "a").repartition(5, "a")
    deal = lambda: bag(split_module._dealt(left, Split(4, 2), None, "__cell_row", "__cell_col", None))
    assert deal() == deal()


def test_keys_of_different_width_hash_alike(spark):
    left = spark.createDataFrame([(i % 5,) for i in range(50)], "a bigint")
    right = relation(spark, [0, 1, 1], "b")
    split = measure(left, right, [("a", "b")], rows_per_cell=4)
    assert split.heavy or split.rows > 1
    assert bag(equi_join(left, right, [("a", "b")], split=split)) == Counter({(0, 0): 10, (1, 1): 20})


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("kind", ["decimal(12,2)", "string", "double", "smallint"])
def test_keys_of_different_kinds_join_alike_at_every_size(spark, threshold, kind, monkeypatch):
    monkeypatch.setattr("conflux.operators.split.MIN_ROWS_PER_CELL", 4)
    left = spark.range(60).select((F.col("id") % 4).cast("int").alias("a"))
    right = spark.range(40).select((F.col("id") % 5).cast(kind).alias("b"))
    expected = Counter({k: 15 * 8 for k in range(4)})
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": threshold}):
        assert Counter(r["a"] for r in equi_join(left, right, [("a", "b")]).collect()) == expected


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
def test_rows_without_an_order_join_alike_at_every_size(spark, threshold, monkeypatch):
    monkeypatch.setattr("conflux.operators.split.MIN_ROWS_PER_CELL", 4)
    left = spark.range(60).select((F.col("id") % 2).alias("a"), F.create_map(F.lit("k"), F.col("id") % 3).alias("m"))
    right = spark.range(20).select((F.col("id") % 2).alias("b"), F.lit("x").alias("y"))
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": threshold}):
        found = equi_join(left, right, [("a", "b")])
        assert Counter((r["a"], r["m"]["k"]) for r in found.collect()) == Counter((i % 2, i % 3) for i in range(60) for _ in range(10))


def test_null_keys_get_no_grid_and_leave_filters_pushed_down(spark, no_broadcast, tmp_path):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 50).alias("a"), F.col("id").alias("x"))
    rows.write.parquet(str(tmp_path / "t"))
    left = spark.read.parquet(str(tmp_path / "t"))
    right = prefixed(left, "b_")
    split = measure(left, right, [("a", "b_a")], rows_per_cell=200)
    assert split.whole
    dealt = equi_join(left, right, [("a", "b_a")], split=Split(2, 2))
    pushed = [line for line in plan_with_filters(dealt).splitlines() if "PushedFilters" in line]
    assert len(pushed) == 2 and all("IsNotNull" in line for line in pushed)
    expected = bag(left.join(right, F.col("a") == F.col("b_a")).groupBy("a").count())
    assert bag(dealt.groupBy("a").count()) == expected


def plan_with_filters(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_two_hundred_hot_keys_get_a_grid_each(spark, no_broadcast):
    left = spark.range(40_000).select((F.col("id") % 200).alias("a"))
    right = spark.range(1000).select((F.col("id") % 1000).alias("b"))
    split = measure(left, right, [("a", "b")], rows_per_cell=100)
    assert len([h for h in split.heavy if h[1] > 1]) == 200 or split.rows > 1
    counts = equi_join(left, right, [("a", "b")], split=split).groupBy("a").count().collect()
    assert Counter(r["count"] for r in counts) == {200: 200}


def test_theta_joins_and_chains_take_ids(spark, no_broadcast):
    left = relation(spark, [1, 1, 2], "a").withColumn("a_id", F.monotonically_increasing_id())
    right = relation(spark, [1, 2, 2], "b").withColumn("b_id", F.monotonically_increasing_id())
    found = theta_join(left, right, lambda l, r: l.a < r.b, side="grid", shape=(2, 2), left_id=["a_id"], right_id=["b_id"])
    assert bag(found.select("a", "b")) == Counter({(1, 2): 4})
    times = [0, 100, 700, 1300, 2500]
    a, b, c = (stamps(spark, times, n) for n in "abc")
    others, splits = [(b, "b_ts"), (c, "c_ts")], [Split(2, 2), Split(2, 3)]
    plain = interval_chain(a, "a_ts", others, WITHIN, [None, None])
    with_ids = interval_chain(a, "a_ts", others, WITHIN, splits, ids=[["a_id"], ["b_id"], ["c_id"]])
    assert bag(with_ids) == bag(plain)


def test_profiles_of_pairs():
    from conflux.operators.split import Profile, split_for

    left, right = Profile(1000, 10, {1: 500}), Profile(200, 10, {1: 20, 2: 110})
    pairs = left.paired(right)
    assert pairs.top == {1: 500 * 20, 2: 100 * 110}
    # A key of 900,000 x 90,000 rows has 810 times the pairs one cell is meant to check.
    large = split_for(Profile(10**6, 2, {1: 900_000}), Profile(10**5, 2, {1: 90_000}), 8, 10**6)
    assert large == Split(50, 5, ((1, 90, 9),))
    assert split_for(pairs, right, 8, rows_per_cell=2000) == Split(1, 1, ((1, 5, 1), (2, 6, 1)))


def test_auto_measures_only_what_cannot_be_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr("conflux.operators.equi.measure", lambda *a: seen.append(a) or Split(2, 2))
    left = spark.range(10).withColumnRenamed("id", "a")
    right = spark.range(5).withColumnRenamed("id", "b")
    expected = Counter({(i, i): 1 for i in range(5)})
    assert bag(equi_join(left, right, [("a", "b")])) == expected
    assert not seen
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        assert bag(equi_join(left, right, [("a", "b")])) == expected
    assert len(seen) == 1


# ---- time --------------------------------------------------------------------------------------

START = datetime(1969, 12, 31, 23, 30)
WITHIN = timedelta(minutes=10)
offsets = st.lists(st.integers(0, 4000), max_size=25)


def stamps(spark, seconds, name):
    rows = [(i, START + timedelta(seconds=s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, f"{name}_id int, {name}_ts timestamp").repartition(3)


def near(left, right):
    return Counter(
        (i, j) for i, x in enumerate(left) for j, y in enumerate(right) if abs(x - y) <= WITHIN.total_seconds()
    )


@given(offsets, offsets, st.sampled_from([Split(), Split(2, 3), "measured"]))
@few
def test_interval_join(spark, left, right, split):
    l, r = stamps(spark, left, "a"), stamps(spark, right, "b")
    if split == "measured":
        split = Split(1, 1, ((0, 2, 2),))
    found = interval_join(l, r, "a_ts", "b_ts", WITHIN, split=split)
    assert found.columns == ["a_id", "a_ts", "b_id", "b_ts"]
    assert bag(found.select("a_id", "b_id")) == near(left, right)


def test_interval_join_at_the_edges(spark):
    left, right = [600, 1200, 1800], [0, 599, 600, 1200, 1201, 2400, 2401]
    found = interval_join(stamps(spark, left, "a"), stamps(spark, right, "b"), "a_ts", "b_ts", WITHIN)
    assert bag(found.select("a_id", "b_id")) == near(left, right)


def test_interval_chain_shuffles_the_first_side_once(spark, no_broadcast):
    times = [0, 100, 700, 1300, 2500]
    a, b, c = (stamps(spark, times, n) for n in "abc")
    found = interval_chain(a, "a_ts", [(b, "b_ts"), (c, "c_ts")], WITHIN, [None, None])
    expected = Counter(
        (i, j, k) for (i, j) in near(times, times) for (i2, k) in near(times, times) if i == i2
    )
    assert bag(found.select("a_id", "b_id", "c_id")) == expected
    assert plan(found).count("Exchange hashpartitioning(__left_bucket") == 1


# ---- summaries ---------------------------------------------------------------------------------


def test_summary_without_pairs_equals_summary_of_pairs(spark):
    a = stamps(spark, [0, 5, 5, 9, 30], "a").withColumn("a_k", F.col("a_id") % 2)
    b = stamps(spark, [1, 2, 2, 40], "b").withColumn("b_k", F.col("b_id") % 3)
    on = [("a_k", "b_k")]
    built = join_summary(equi_join(a, b, on), F.least("a_ts", "b_ts"), F.greatest("a_ts", "b_ts"))
    assert bag(built) == bag(equi_join_summary(a, b, on, "a_ts", "b_ts"))


def test_summary_of_nothing_and_of_no_time(spark):
    a = stamps(spark, [5], "a")
    row = join_summary(a, F.col("a_ts"), F.col("a_ts")).first()
    assert (row["size"], row["elapsed_ms"], row["per_ms"]) == (1, 0, None)
    assert join_summary(a.where("false"), F.col("a_ts"), F.col("a_ts")).first()["size"] == 0
    assert equi_join_summary(a.where("false"), stamps(spark, [5], "b"), [("a_id", "b_id")], "a_ts", "b_ts").first()[
        "size"
    ] == 0


def test_chain_summary_equals_summary_of_the_chain(spark):
    rows = {n: stamps(spark, [5, 9, 1, 30, 7, 2, 44], n).withColumn(f"{n}_k", F.pmod(F.col(f"{n}_id") * 3, F.lit(5))) for n in "abc"}
    on = F.expr("a_k < b_k and b_k < c_k")
    built = join_summary(
        rows["a"].crossJoin(rows["b"]).crossJoin(rows["c"]).where(on), F.least("a_ts", "b_ts", "c_ts"), F.greatest("a_ts", "b_ts", "c_ts")
    )
    found = chain_summary([(rows[n], f"{n}_k", f"{n}_ts") for n in "abc"])
    assert tuple(found.first()) == tuple(built.first())
    nothing = chain_summary([(rows["a"], "a_k", "a_ts"), (rows["b"].where("false"), "b_k", "b_ts")])
    assert nothing.first()["size"] == 0


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_running_extremes(spark, parts):
    rows = spark.createDataFrame([(k, 10 * k % 7, 10 * k % 11) for k in (1, 2, 4, 5, 8, 9, 12)], "k int, n int, t int")
    at = spark.createDataFrame([(k, k * k) for k in (0, 1, 2, 3, 8, 13)], "k int, x int")
    found = running_extremes(rows, "k", ["n"], ["t"], [], at, parts)
    known = [tuple(r) for r in rows.collect()]
    for r in found.collect():
        before = [x for x in known if x[0] < r["k"]]
        assert (r["x"], r["n_before"]) == (r["k"] ** 2, sum(x[1] for x in before))
        assert r["t_before"] == (min(x[2] for x in before) if before else None)


@pytest.mark.parametrize("splits", [[Split(), Split(2, 3)], [Split(2, 1), Split(1, 1, ((1, 2, 2),))], "hot"])
def test_interval_chain_with_grids_shuffles_and_numbers_no_pairs(spark, no_broadcast, splits):
    """What the first join finds stays in its cell; copies of a row count each."""
    times = [0, 0, 100, 700, 700, 1300, 2500]
    a, b, c = (stamps(spark, times, n) for n in "abc")
    if splits == "hot":
        keys = with_bucket(a, "a_ts", WITHIN)
        hashes = sorted({r[0] for r in keys.select(key_hash(keys, ["__left_bucket"])).collect()})
        splits = [Split(), Split(1, 1, tuple((h, 2 + i, 2) for i, h in enumerate(hashes[:2])))]
    found = interval_chain(a, "a_ts", [(b, "b_ts"), (c, "c_ts")], WITHIN, splits)
    pairs = near(times, times)
    assert bag(found.select("a_id", "b_id", "c_id")) == Counter((i, j, k) for (i, j) in pairs for (i2, k) in pairs if i == i2)
    assert found.columns == ["a_id", "a_ts", "b_id", "b_ts", "c_id", "c_ts"]
    text = plan(found)
    assert text.count("Exchange hashpartitioning(__left_bucket") == 1
    assert text.count("monotonically_increasing_id") <= 4  # both sides of the first join, none of the pairs


def test_many_even_buckets_are_not_divided(spark, no_broadcast, monkeypatch):
    """However many candidates each has: its part of a core's share is small."""
    monkeypatch.setattr("conflux.operators.interval.PAIRS_PER_KEY_CELL", 10)
    monkeypatch.setattr("conflux.operators.split.PAIRS_PER_KEY_CELL", 10)
    start = datetime(2024, 1, 1)
    even = [(i, start + timedelta(minutes=20 * (i // 5))) for i in range(3000)]
    hot = even + [(3000 + i, start) for i in range(3000)]
    for rows, divided in ((even, False), (hot, True)):
        a, b, c = (spark.createDataFrame(rows, f"{n}_id int, {n}_ts timestamp") for n in "abc")
        splits = bucket_splits(a, "a_ts", [(b, "b_ts"), (c, "c_ts")], WITHIN)
        assert (not all(s.whole for s in splits)) == divided
