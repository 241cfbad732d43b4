"""Allow and block rules for URLs by host and path, matched with a sort-merge range join.

A host is written with its labels reversed (``com.example.www.``), so a rule for a host and its subdomains is a prefix, and a
prefix is an interval of the sorted keys; so is a path prefix. Intervals of prefixes are nested or apart. A sweep over the
sorted starts, ends and keys keeps the stack of the rules that are open: the rule at each depth is the last one that started
at it. The first sweep finds the rule hosts above each host, the second one the longest path rule of each of those.
Everything is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conflux.llm.tables import packed, saved

_END, _START, _POINT = 0, 1, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, in lower case; empty for null and without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``action``, ``host``, ``path`` from pairs such as ``("block", "example.com/en/")``."""
    parts = [(action, *rule.partition("/")) for action, rule in rules]
    rows = [
        F.struct(F.lit(action).alias("action"), F.lit(host).alias("host"), F.lit(slash + path).alias("path"))
        for action, host, slash, path in parts
    ]
    if not rows:
        return spark.createDataFrame([], "action string, host string, path string")
    return spark.range(1).select(F.inline(F.array(*rows)))


def open_prefixes(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``key`` and ``stack``: for each distinct ``key``, the distinct ``prefix`` values it starts with, shortest first.

    Both are strings, compared as UTF-8 bytes. The events are dealt to tasks by ranges of keys, and a range begins with the
    prefixes that are still open there: at most one for each depth of nesting.
    """
    points = keys.select(F.col("key").cast("binary").alias("at"), F.lit(_POINT).alias("kind"), F.lit(None).cast("string").alias("prefix"))
    named = prefixes.select("prefix", F.col("prefix").cast("binary").alias("at")).distinct()
    # The byte 0xFF is in no UTF-8 text, so with it a prefix sorts right after all keys that start with it.
    bounds = named.select(
        "prefix",
        F.inline(
            F.array(
                F.struct("at", F.lit(_START).alias("kind")),
                F.struct(F.concat("at", F.unhex(F.lit("FF"))).alias("at"), F.lit(_END).alias("kind")),
            )
        ),
    )
    events = points.distinct().unionByName(bounds.select("at", "kind", "prefix"))
    dealt = saved(events.repartitionByRange("at", "kind").withColumn("part", F.spark_partition_id()), "url-events")

    ends = dealt.where(F.col("kind") == _END).select("prefix", F.col("part").alias("last"))
    starts = dealt.where(F.col("kind") == _START).select("prefix", "at", F.col("part").alias("first"))
    spans = starts.join(ends, "prefix").where("first < last")
    carried = spans.select(F.explode(F.sequence(F.col("first") + 1, "last")).alias("part"), "prefix", "at")
    steps = dealt.withColumn("carried", F.lit(1)).unionByName(
        carried.select("at", F.lit(_START).alias("kind"), "prefix", "part", F.lit(0).alias("carried"))
    )
    sweep = Window.partitionBy("part").orderBy("carried", "at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == _START, 1).when(F.col("kind") == _END, -1).otherwise(0)
    steps = steps.withColumn("depth", F.sum(step).over(sweep))
    deepest = steps.agg(F.max("depth")).first()[0] or 0
    opened = [
        F.last(F.when((F.col("kind") == _START) & (F.col("depth") == d), F.col("prefix")), ignorenulls=True).over(sweep)
        for d in range(1, deepest + 1)
    ]
    stack = F.slice(F.array(*opened), 1, F.col("depth").cast("int")) if opened else F.array().cast("array<string>")
    swept = steps.select("at", "kind", stack.alias("stack"))
    return swept.where(F.col("kind") == _POINT).select(F.col("at").cast("string").alias("key"), "stack")


def judged(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``row`` (a struct of all columns), ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``urls``.

    A rule (``action``, ``host``, ``path``) fits its host and all subdomains where the URL's path starts with the rule's.
    The longest rule wins, host and path together; then the one with the longer host; of equal rules, block. Where none fits, ``rule``
    is null and the verdict is ``default``. Null URLs and those without ``://`` have an empty host and path. Repeated rows
    come out repeated. Rules with a null are left out.
    """
    clean = rules.where("action is not null and host is not null and path is not null").select(
        "action", F.translate("host", _UPPER, _LOWER).alias("host"), "path"
    )
    known = clean.groupBy("host", "path").agg(F.max(F.struct((F.col("action") == "block").alias("b"), "action"))["action"].alias("action"))
    known = known.select(F.concat("host", "path").alias("rule"), "action", reversed_host(F.col("host")).alias("anchor"), "path", F.length("host").alias("n_host"))
    known = saved(known.withColumn("prefix", F.concat("anchor", "path")), "url-rules")

    rows = packed(urls).select("row", host_of(F.col(f"row.`{url}`")).alias("host"), path_of(F.col(f"row.`{url}`")).alias("path"))
    distinct = saved(rows.select("host", "path").distinct().withColumn("reversed", reversed_host(F.col("host"))), "url-distinct")
    hosts = distinct.select(F.col("reversed").alias("key")).distinct()
    above = open_prefixes(hosts, known.select(F.col("anchor").alias("prefix")))
    anchors = above.select(F.col("key").alias("reversed"), F.explode("stack").alias("anchor"))
    anchors = saved(anchors, "url-anchors")
    tried = distinct.join(anchors, "reversed").select("host", "path", F.concat("anchor", "path").alias("key"))
    # Keys are distinct, so the rows of a popular host are dealt by their paths.
    tried = saved(tried, "url-tried")
    longest = open_prefixes(tried.select("key").distinct(), known.select("prefix"))
    longest = longest.select("key", F.try_element_at("stack", F.lit(-1)).alias("prefix")).where("prefix is not null")
    fit = tried.join(longest, "key").join(known.select("prefix", "rule", "action", "n_host"), "prefix")
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "n_host", "rule", "action")).alias("best"))
    best = saved(best.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "best.rule", "best.action"), "url-judged")
    met = rows.join(best, (rows["host"] == best["of_host"]) & (rows["path"] == best["of_path"]), "left")
    return met.select("row", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))
