import sys
from collections import Counter
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from conflux.session import session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", app="tests", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    s.sparkContext.setLogLevel("OFF")
    return s


@pytest.fixture
def no_broadcast(spark):
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        yield


@contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bag(df):
    columns = sorted(df.columns)
    return Counter(tuple(row[c] for c in columns) for row in df.select(columns).collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cut_in_files(df, path, n, order=None):
    """Write ``df`` as ``n`` files that a stream reads one after the other."""
    rows = df.orderBy(order).collect() if order else df.collect()
    size = -(-len(rows) // n)
    for i in range(n):
        part = df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1)
        part.write.mode("append").parquet(str(path))
    return str(path)
