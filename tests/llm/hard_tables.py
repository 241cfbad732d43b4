"""Tables for the tests of operators: empty ones, and ones with all that is hard about real documents."""

import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and thing eron blethe anow thst erha lyat inge onwh edre tion haand".split()


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, schema=DOCUMENTS):
        return spark.createDataFrame(rows, schema)

    return make


def sentence(n, seed=0):
    """``n`` words that hardly repeat in order, the same for the same seed."""
    out, x = [], seed * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 16) % len(WORDS)] + "abcdefgh"[x >> 8 & 7])
    return " ".join(out)


@pytest.fixture(scope="session")
def hard_documents(documents):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and extra columns with clashing names."""
    long = sentence(30_000, 5)
    rows = [
        (1, sentence(60, 1), "en", "a", 300),
        (1, sentence(60, 1), "en", "a", 300),
        (1, sentence(60, 2), "en", "b", 300),
        (2, sentence(60, 1), None, None, None),
        (None, sentence(60, 1), "en", "a", 300),
        (None, None, None, None, None),
        (3, None, "en", "a", None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "en", "b", 4),
        (6, "\n\n", "en", "b", 2),
        (7, "12 34 !?", "en", "b", 8),
        (8, long, "fr", "c", len(long)),
        (9, "x" * 50_000, "fr", "c", 50_000),
        (10, "日本語のテキスト 😀 naïve", "fr", "", 20),
        (11, "A\u00a0b", "fr", "c", 3),
    ]
    df = documents(rows)
    for name in "row id tie fp key of part slot position text_new site pos h1 gram t1 places kept mention".split():
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents([])
