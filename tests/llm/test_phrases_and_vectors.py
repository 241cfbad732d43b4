"""Collocations, near copies of embeddings and hard negatives against plain versions, and on tables that are hard or empty."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hard_tables import documents, hard_documents, no_documents  # noqa: F401
from pyspark.sql import functions as F

from conflux.llm import collocations as phrases
from conflux.llm import embedding_copies as copies
from conflux.llm import hard_negatives as hard
from conflux.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"
CHECK = "/root/testdata/check_s"

# ---- collocations ----------------------------------------------------------------------------


def plain_phrases(rows, least, top=2000):
    counts = defaultdict(Counter)
    for lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", lowered):
            words = re.findall(r"[^ \t]+", piece)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, count in counts.items():
        n = sum(f for p, f in count.items() if len(p) == 1)
        kept = []
        for p, a in count.items():
            if len(p) == 1 or a < least:
                continue
            longer = [f for q, f in count.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and f >= least]
            if any(100 * f >= 80 * a for f in longer):
                continue
            cuts = [(2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def some_texts(n=60):
    draw = random.Random(4)
    words = ["the", "of", "New", "york", "a b", "x\x01", "x", "é", "日本", "\x00", "end"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(60):
            parts.append(draw.choice(words))
            parts.append(draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "; "]))
            if draw.random() < 0.2:
                parts.append("New York of the ")
        rows.append((draw.choice(["en", "fr", None]), "".join(parts)))
        if i % 9 == 0:
            rows.append(("en", "San Francisco  bay area! " * 3))
    return [*rows, ("und", "a a a a a"), ("en", None), ("fr", ""), ("xx", ". ,"), ("en", " ")]


@pytest.mark.parametrize("held", [phrases.HELD, 50])
@pytest.mark.parametrize("least", [1, 4])
def test_phrases(spark, held, least):
    rows = some_texts(12 if least == 1 else 60)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=least, held=held).collect())
    assert got == plain_phrases(rows, least)


def test_first_phrases_of_each_language(spark):
    rows = some_texts()
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=4, top=7).collect())
    assert got == plain_phrases(rows, 4, top=7)


def test_a_full_bitmap_only_costs_time(spark):
    rows = some_texts()
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=4, bits=64).collect())
    assert got == plain_phrases(rows, 4)


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(big - 1, big), (big, 3)], "a long, b long")
    got = [r[0] for r in df.select(phrases._divided(F.col("a"), F.col("b"), 2_000_000)).collect()][0]
    assert got == 2_000_000 * (big - 1) // big


# ---- near copies of vectors ------------------------------------------------------------------


def plain_copies(rows):
    known = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            known.append((i, np.float32(v).astype(float), label))
    by = defaultdict(list)
    for i, v, label in known:
        by[label, len(v)].append((i, v / np.linalg.norm(v)))
    links = defaultdict(set)
    for group in by.values():
        g = np.stack([v for _, v in group])
        for a, b in zip(*np.nonzero(g @ g.T >= 0.98), strict=True):
            if a != b:
                links[group[a][0]].add(group[b][0])
    out = []
    for i, (own, _, _) in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            new = links[front.pop()] - seen
            seen |= new
            front += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((own, len(links[i]), least, own is not None and own == least))
    return Counter(out)


def some_vectors(n=700, size=24, seed=1):
    """Copies of a few vectors with noise that puts many pairs near the limit, one large group, and chains."""
    draw = np.random.default_rng(seed)
    base = draw.normal(size=(30, size))
    base /= np.linalg.norm(base, axis=1)[:, None]
    rows = []
    for i in range(n):
        k = 0 if i % 3 == 0 else int(draw.integers(30))
        v = (base[k] + draw.normal(size=size) * draw.choice([0.0, 0.01, 0.02, 0.025, 0.05])) * draw.uniform(0.1, 50)
        rows.append((i * 3 + 1, [float(np.float32(x)) for x in v], 0 if k == 0 else k % 3))
    step = np.eye(size)
    for j in range(40):
        v = step[0] * math.cos(j * 0.18) + step[1] * math.sin(j * 0.18)
        rows.append((9000 - j, [float(np.float32(x)) for x in v], 7))
    return rows


ODD = [
    (None, [1.0, 2.0], 1), (20001, [1.0, 2.0], 1), (20001, [2.0, 4.0], 1), (20002, [1.0, 2.0], 2), (20003, None, 1), (20004, [0.0, 0.0], 1),
    (20005, [1.0, None], 1), (20006, [1.0, float("nan")], 1), (20007, [float("inf"), 1.0], 1), (20008, [1.0, 2.0], None), (None, None, None),
    (20009, [], 1), (20010, [1.0, 2.0, 0.0], 1), (20011, [3e38, 3e38], 1), (20012, [1e-38, 1e-38], 1), (20013, [1.0, 2.0], 1),
    (20013, [1.0, 2.0], 1), (None, [5.0, -5.0], 4), (20014, [-0.0, 1.0], 3), (20015, [0.0, 1.0], 3),
]


@pytest.mark.parametrize("bounds", [{}, {"list_size": 40, "block": 16}, {"list_size": 10**6, "block": 50}])
def test_copies(spark, bounds):
    rows = some_vectors() + ODD
    df = spark.createDataFrame(rows, VECTORS).withColumn("node", F.lit(1)).withColumn("list", F.lit("clash")).repartition(3)
    got = copies.embedding_copies(df, **bounds)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert Counter(tuple(r) for r in got.collect()) == plain_copies(rows)


def test_no_link_is_lost_in_a_table_with_large_groups(spark):
    df = spark.read.parquet(f"{CHECK}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert Counter(tuple(r) for r in copies.embedding_copies(df).collect()) == plain_copies(rows)


def test_bounds_of_table_distances():
    draw = np.random.default_rng(2)
    index = copies.fit(copies.units(draw.normal(size=(900, 30))), 20)
    vectors = draw.normal(size=(400, 30))
    turned = index.turned(vectors)
    row, lists, codes, off = copies._entries(turned, index, 0.05)
    for entry in np.unique(lists)[::9].tolist():
        of = np.flatnonzero(lists == entry)
        segment, centroid = index.of(entry)
        part = turned.copy()
        part[:, segment * index.width : (segment + 1) * index.width] -= centroid
        code = np.stack([np.frombuffer(codes[i], np.uint8) for i in of])
        told = copies.table_distances(part[:50], code, index.frame(segment))
        true = np.linalg.norm(turned[row[of]][:, None] - turned[None, :50], axis=2)
        assert (told - off[of][:, None] <= true + 1e-3).all() and (told + off[of][:, None] >= true - 1e-3).all()
        assert (told - off[of][:, None] > 0.2).mean() > 0.9


def test_linked_vectors_share_a_list():
    draw = np.random.default_rng(3)
    index = copies.fit(copies.units(draw.normal(size=(3000, 30))), 100)
    vectors = copies.units(draw.normal(size=(500, 30)))
    # Differences in all components, in one, and along the way to another vector.
    others = [vectors + draw.normal(size=vectors.shape) * 0.036, vectors + np.eye(30)[draw.integers(30, size=500)] * 0.2, vectors * 0.86 + vectors[::-1] * 0.14]
    row, lists, *_ = copies._entries(index.turned(vectors), index, 0.05)
    mine, n = [set(lists[row == i].tolist()) for i in range(500)], 0
    for other in others:
        row, lists, *_ = copies._entries(index.turned(other), index, 0.05)
        linked = (copies.units(other) * vectors).sum(axis=1) >= 0.98
        for i in np.flatnonzero(linked):
            n += 1
            assert mine[i] & set(lists[row == i].tolist())
    assert n > 500 and np.mean([len(m) for m in mine]) < 40


# ---- hard negatives --------------------------------------------------------------------------


def plain_negatives(rows, every=100):
    known = {}
    for i, v, label in rows:
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(np.float32(x))) for x in v]
            known[i] = min(known.get(i, (label, q)), (label, q))
    out = set()
    for a, (label, v) in known.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, (other, w) in known.items() if i != a)
        for ps, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out |= {(a, p, k, i, -ps, -s) for k, (s, i, _) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("bounds", [{}, {"block": 37, "group": 4}])
def test_negatives(spark, bounds):
    draw = np.random.default_rng(3)
    rows = [(i * 10, v, label if draw.random() < 0.7 else int(draw.integers(8))) for i, v, label in some_vectors()]
    rows = [(i // 10, v, label) for i, v, label in rows] + [r for r in ODD if not r[1] or max(abs(x or 0) for x in r[1]) < 1e6 or math.isnan(sum(r[1]))]
    rows += [(30000 + k, [float(draw.integers(-2, 3)) / 256 for _ in range(24)], int(draw.integers(3))) for k in range(250)]
    rows += [(-100, [0.0] * 24, 1), (31000, [0.01] * 24, 1), (31000, [0.02] * 24, 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("part", F.lit("clash")).withColumn("id", F.lit(3)).repartition(5)
    got = hard.hard_negatives(df, **bounds)
    assert dict(got.dtypes)["rank"] == "int"
    assert {tuple(r) for r in got.collect()} == plain_negatives(rows)


def test_the_search_stops_early():
    """Rows whose scores fall off steeply: few are met, and the first ones are among them."""
    draw = np.random.default_rng(5)
    vectors = (draw.pareto(1.2, size=(4000, 3)) * 100).astype(np.int64).astype(float)
    block = hard.Block(np.arange(4000), np.zeros(4000, np.int64), vectors)
    anchors = hard.Anchors(np.array([-1]), np.array([0]), np.array([[3.0, 1.0, 2.0]]))
    search, met = hard.Positives(anchors, 5), []
    inner = block.search
    block.search = lambda anchor, goal, take: inner(anchor, goal, lambda rows, scores: (met.extend(rows.tolist()), take(rows, scores)))
    search.read(block)
    scores = vectors @ anchors.vectors[0]
    assert len(met) == len(set(met)) < 1000
    assert [r[1] for r in search.rows()] == np.lexsort((np.arange(4000), -scores))[:5].tolist()


# ---- all three -------------------------------------------------------------------------------


def test_hard_and_empty_documents(hard_documents, no_documents):  # noqa: F811
    got = phrases.collocations(hard_documents, least=2)
    rows = [(r["lang"], r["text"]) for r in hard_documents.collect() if len(r["text"] or "") < 20_000]
    assert got.count() > 0 and {r["lang"] for r in got.collect()} <= {"en", "fr", "und"}
    assert len([r for r in got.collect() if r["lang"] == "en"]) == len([r for r in plain_phrases(rows, 2) if r[0] == "en"])
    assert phrases.collocations(no_documents).count() == 0


@pytest.mark.parametrize("operator", [copies.embedding_copies, hard.hard_negatives])
def test_no_vectors(spark, operator):
    assert operator(spark.createDataFrame([], VECTORS)).count() == 0
    rows = operator(spark.createDataFrame([(100, None, 1), (None, [1.0], None)], VECTORS)).collect()
    assert [tuple(r) for r in rows if r[0] == 100] == ([(100, 0, 100, True)] if operator is copies.embedding_copies else [])


def test_queries_of_vectors_where_labels_are_shifted(spark):
    got = {tuple(r) for r in QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got == plain_negatives([(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows])
