"""Each operator and stage on tables that are empty, or full of nulls, empty and long texts, repeated rows and clashing names."""

from pathlib import Path

import corpus_pipeline
import pytest
from hard_tables import documents, hard_documents, no_documents  # noqa: F401
from pyspark.sql import functions as F

from conflux.llm.decontaminate import contamination
from conflux.llm.digest import with_next
from conflux.llm.langid import identify, train
from conflux.llm.line_dedup import without_boilerplate
from conflux.llm.mixing import mixed
from conflux.llm.queries import QUERIES
from conflux.llm.simhash import near_copies
from conflux.llm.substrings import without_repeats
from conflux.llm.surrogates import replaced
from conflux.llm.token_count import Unigram, token_counts
from conflux.llm.url_rules import judged, rules_table


def benchmark_of(docs):
    text = "eight words at least are needed for it. And an answer."
    return docs.sparkSession.createDataFrame([(1, text), (2, None), (None, text), (3, "short"), (1, text)], "item_id long, text string")


OPERATORS = {
    "lines": lambda d: without_boilerplate(d),
    "digest": lambda d: with_next(d),
    "tokens": lambda d: token_counts(d, Unigram.of(["▁", "▁the", "a", "b", "th"])),
    "simhash": lambda d: near_copies(d),
    "decontaminate": lambda d: contamination(d, benchmark_of(d)),
    "urls": lambda d: judged(d.withColumn("url", F.col("text")), rules_table(d.sparkSession, [("block", "a.b/")])),
    "surrogates": lambda d: replaced(d, "key"),
    "language": lambda d: identify(d, train(d)),
    "mix": lambda d: mixed(d),
    "substrings": lambda d: without_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(hard_documents, name):
    assert OPERATORS[name](hard_documents).count() == hard_documents.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table(no_documents, name):
    assert OPERATORS[name](no_documents).count() == 0


def write(docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    benchmark_of(docs).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_return_the_columns_of_documents(spark, hard_documents, tmp_path):
    folder = write(hard_documents, tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == hard_documents.columns, name
        assert out.count() <= docs.count()
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*hard_documents.columns, "mix_position"]
    kept = [r["text"] for r in out.collect()]
    assert all(kept) and len(set(kept)) == len(kept)


def test_stages_of_an_empty_table(spark, no_documents, tmp_path):
    folder = write(no_documents, tmp_path)
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert Path(corpus_pipeline.__file__).parent == Path(__file__).resolve().parents[2]
