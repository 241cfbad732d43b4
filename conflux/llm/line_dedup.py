"""Removal of boilerplate lines: lines that stand in documents of many sites.

The spread of a line is its number of distinct sites. HyperLogLog sketches of the sites, one per line hash, are merged by
aggregation, before and after the shuffle. Lines whose estimate is so near the threshold that the sketch's error could
decide get an exact distinct count. Of a boilerplate line the first occurrence, by document id and position, stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflux.llm.tables import merged, packed, saved, text_key

SITES = 10
LG_K = 12
# Five standard errors of a sketch with 2^12 registers are 8 % of the estimate.
NEAR = 0.08


def _lines(docs: DataFrame, id_column: str, text: str, site: str) -> DataFrame:
    """``id``, ``tie``, ``site``, ``pos`` and the hashes ``h1``, ``h2`` of every line that is not blank."""
    named = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text).alias("tie"), F.col(site).cast("string").alias("site"), F.col(text).alias("text")
    )
    lines = named.select("id", "tie", "site", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    h1, h2 = text_key(F.col("line"))
    return lines.where(F.trim("line") != "").select("id", "tie", "site", "pos", h1.alias("h1"), h2.alias("h2"))


def boilerplate(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES
) -> DataFrame:
    """``h1``, ``h2`` of the lines with ``sites`` distinct sites or more, and their ``first`` occurrence (id, text hash, position).

    Lines are compared as they are, whole and with case; blank lines never count. Null sites count as no site.
    """
    lines = _lines(docs, id_column, text, site)
    occurrence = F.struct(F.col("id").isNull().alias("no_id"), "id", "tie", "pos")
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("about"), F.min(occurrence).alias("first")
    )
    likely = saved(spread.where(F.col("about") * (1 + NEAR) + 1 > sites), "lines-spread")
    near = F.abs(F.col("about") - sites) <= NEAR * sites + 1
    unsure = likely.where(near).select("h1", "h2")
    exact = lines.join(unsure, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct()
    exact = exact.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= sites).select("h1", "h2")
    sure = likely.where(~near & (F.col("about") >= sites))
    return sure.select("h1", "h2", "first").unionByName(
        likely.where(near).join(exact, ["h1", "h2"], "left_semi").select("h1", "h2", "first")
    )


def removed_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES
) -> DataFrame:
    """``id``, ``tie`` (a hash of the text) and ``gone``, the sorted positions of the lines to remove, of documents that have any."""
    common = saved(boilerplate(docs, id_column, text, site, sites), "lines-boilerplate")
    met = _lines(docs, id_column, text, site).select("id", "tie", "pos", "h1", "h2").join(common, ["h1", "h2"])
    here = F.struct(F.col("id").isNull().alias("no_id"), "id", "tie", "pos")
    later = met.where(here != F.col("first"))
    return later.groupBy("id", "tie").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def without_boilerplate(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", site: str = "source", sites: int = SITES
) -> DataFrame:
    """``row`` (a struct of all columns), ``n_lines``, ``n_removed`` and ``kept``, the text without its boilerplate lines.

    One row for each row of ``docs``. A null text stays null with 0 lines; an empty one has one blank line and stays empty.
    Rows that agree in id and text are treated alike: if they hold a line's first occurrence, all of them keep it.
    """
    gone = saved(removed_lines(docs, id_column, text, site, sites), "lines-gone")
    gone = gone.select(F.col("id").alias("gone_id"), F.col("tie").alias("gone_tie"), "gone")
    rows = packed(docs).withColumn("id", F.col(f"row.`{id_column}`")).withColumn("tie", F.xxhash64(f"row.`{text}`"))
    met = rows.join(merged(gone), rows["id"].eqNullSafe(gone["gone_id"]) & (rows["tie"] == gone["gone_tie"]), "left")
    whole = F.col(f"row.`{text}`")
    lines = F.split(whole, "\n")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("gone", i)), "\n")
    return met.select(
        "row",
        F.coalesce(F.array_size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), whole).otherwise(left).alias("kept"),
    )


def deduplicated(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", site: str = "source", length: str = "n_chars", sites: int = SITES
) -> DataFrame:
    """The rows of ``docs``, all columns, with their boilerplate lines taken out of the text, and ``length`` brought up to date.

    A document of which only blank lines would be left is dropped, as all its lines stand elsewhere.
    """
    found = without_boilerplate(docs, id_column, text, site, sites)
    found = found.where((F.col("n_removed") == 0) | (F.trim(F.translate("kept", "\n\r\t", "   ")) != ""))
    row = F.col("row").withField(f"`{text}`", F.col("kept"))
    if length in docs.columns:
        now = F.char_length("kept").cast(docs.schema[length].dataType)
        row = row.withField(f"`{length}`", F.when(F.col("n_removed") > 0, now).otherwise(F.col(f"row.`{length}`")))
    return found.select(row.alias("row")).select("row.*")
