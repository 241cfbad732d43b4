"""Documents that hold passages of a benchmark, also reworded ones, by latent semantic retrieval.

Items are cut into passages of words. Their TF-IDF matrix, with document frequencies from all documents, is reduced by a
randomised SVD whose products are summed up by Spark. Windows of the documents are projected into the same space and those
with a cosine above a limit to a passage are candidates of its item. A candidate is confirmed by the longest common
subsequence of words, and where that is not clear by itself, by whether the item's answer (its last sentence) is there too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflux.llm.tables import arrow_map, chunks, saved, text_column

# Words of a passage, and between the starts of two of them.
STRIDE = 16
WIDTH = 2 * STRIDE
RANK, OVERSAMPLING, ROUNDS = 128, 16, 2
# On the benchmark passages of the test tables, unchanged ones have a cosine of 0.98 or more, ones with 30 % of their words replaced
# 0.89. Also, a window must have this part of a passage's length in its direction: one that has no more than a word or two
# in common can have any cosine.
COSINE, PART = 0.75, 0.3
# Share of an item's words, in order, that confirms it alone, and with its answer; share of the answer's words.
ALONE, WITH_ANSWER, ANSWER = 0.75, 0.5, 0.75
# An item of fewer words can't be told from chance and is not searched for.
LEAST_WORDS = 8
# Items searched for at a time: this bounds the vocabulary and the vectors that every task holds.
ITEMS = 2000
# Bytes of text whose windows are projected at a time.
TEXT_BYTES = 200_000
# Rows of a word matrix that are summed up together.
ROWS = 512
# Words in more than this share of the documents have no weight, provided that each passage has enough words left; otherwise the
# share is doubled.
COMMON, ENOUGH = 1 / 16, 6

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.?!\n]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def passages_of(words: list[str]) -> list[list[str]]:
    last = max(0, len(words) - WIDTH)
    starts = sorted({*range(0, last, STRIDE), last})
    return [words[s : s + WIDTH] for s in starts]


def common_length(item: dict[str, int], size: int, words: list[str]) -> int:
    """Length of the longest common subsequence; ``item`` has for each word a bit mask of its positions."""
    mask = (1 << size) - 1
    rest = mask
    for word in words:
        if hit := item.get(word):
            both = rest & hit
            rest = ((rest + both) | (rest - both)) & mask
    return size - rest.bit_count()


def _masks(words: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


@dataclass(frozen=True)
class Item:
    item_id: object
    size: int
    masks: dict[str, int]
    answer_size: int
    answer: dict[str, int]

    @staticmethod
    def of(item_id: object, text: str) -> Item:
        words = words_of(text)
        sentences = [w for s in _SENTENCE.split(text) if (w := words_of(s))]
        answer = sentences[-1] if len(sentences) > 1 else []
        return Item(item_id, len(words), _masks(words), len(answer), _masks(answer))

    def share_in(self, words: list[str]) -> float:
        """The share of the item's words found in order, 0 if that doesn't confirm it."""
        there = sum(self.masks[w].bit_count() for w in self.masks.keys() & words)
        if there < WITH_ANSWER * self.size:
            return 0.0
        share = common_length(self.masks, self.size, words) / self.size
        if share >= ALONE:
            return share
        if share >= WITH_ANSWER and self.answer_size:
            if common_length(self.answer, self.answer_size, words) >= ANSWER * self.answer_size:
                return share
        return 0.0


@dataclass(frozen=True)
class Retrieval:
    """What a task needs to search for a block of items."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    vectors: np.ndarray
    passages: np.ndarray
    lengths: np.ndarray
    item_of: np.ndarray
    items: list[Item]
    least_mass: float

    def found_in(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """For each text, the items in it, by their number, and the share of their words."""
        out: list[list[tuple[int, float]]] = []
        for a, b in chunks([t or "" for t in texts], TEXT_BYTES):
            split = [words_of(t) for t in texts[a:b]]
            near: list[dict[int, set[int]]] = [{} for _ in split]
            for i, number, start in self._candidates(split):
                near[i].setdefault(number, set()).add(start)
            out += [self._confirmed(words, places) for words, places in zip(split, near, strict=True)]
        return out

    def _candidates(self, split: list[list[str]]) -> Iterator[tuple[int, int, int]]:
        """Text, item and first word of windows near one of the item's passages. A window is two blocks of words in a row."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for words in split for w in words], np.int64)
        sizes = np.array([len(words) for words in split])
        blocks = np.maximum(1, -(-sizes // STRIDE))
        first_block = np.cumsum(blocks) - blocks
        at = np.arange(len(ids)) + np.repeat(first_block * STRIDE - (np.cumsum(sizes) - sizes), sizes)
        hits = np.flatnonzero(ids >= 0)
        if not len(hits):
            return
        block, ids = at[hits] // STRIDE, ids[hits]
        n = int(blocks.sum())
        mass = np.append(np.bincount(block, self.idf[ids] ** 2, n), 0.0)
        owner = np.repeat(np.arange(len(split)), blocks)
        ahead = np.where(np.append(owner[1:] == owner[:-1], False), np.arange(1, n + 1), n)
        # The last block of a text has been in the window before, unless it is the only one.
        start = (ahead < n) | (blocks[owner] == 1)
        chosen = np.flatnonzero(start & (mass[:-1] + mass[ahead] >= self.least_mass))
        needed = np.zeros(n + 1, bool)
        needed[chosen] = needed[ahead[chosen]] = True
        kept = needed[block]
        block, ids = block[kept], ids[kept]
        edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))[: len(block)]
        sums = np.zeros((n + 1, self.vectors.shape[1]), np.float32)
        if len(block):
            sums[block[edges]] = np.add.reduceat(self.vectors[ids], edges, axis=0)
        for k in range(0, len(chosen), 1024):
            part = chosen[k : k + 1024]
            rows = sums[part] + sums[ahead[part]]
            limits = np.maximum(COSINE * np.linalg.norm(rows, axis=1, keepdims=True), PART * self.lengths)
            for w, p in zip(*np.nonzero(rows @ self.passages.T >= limits), strict=True):
                i = int(owner[part[w]])
                yield i, int(self.item_of[p]), int(part[w] - first_block[i]) * STRIDE

    def _confirmed(self, words: list[str], places: dict[int, set[int]]) -> list[tuple[int, float]]:
        found = []
        for number, starts in places.items():
            item, best = self.items[number], 0.0
            for start in sorted(starts):
                begin = max(0, start - item.size)
                best = max(best, item.share_in(words[begin : start + WIDTH + item.size]))
                if best == 1.0:
                    break
            if best:
                found.append((number, best))
        return found


def _frequencies(docs: DataFrame, vocabulary: dict[str, int], text: str) -> np.ndarray:
    """In how many documents each word of the vocabulary occurs, and last the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = shared.value, np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for t in text_column(batch, text):
                n[[known[w] for w in set(words_of(t)) if w in known]] += 1
                n[-1] += 1
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["word", "n"])

    sums = arrow_map(docs.select(text), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(len(vocabulary) + 1, np.int64)
    n[sums.column("word").to_numpy()] = sums.column("n").to_numpy()
    return n


def _weights(frequencies: np.ndarray, passages: list[list[int]]) -> np.ndarray:
    """Inverse document frequencies, 0 for common words; the last of ``frequencies`` is the number of documents."""
    df, n = frequencies[:-1], max(int(frequencies[-1]), 1)
    share, distinct = COMMON, [np.unique(p) for p in passages]
    while share < 1 and any((df[p] <= share * n).sum() < min(ENOUGH, len(p)) for p in distinct):
        share *= 2
    return np.where((df <= share * n) | (share >= 1), np.log((n + 1) / (df + 1)) + 0.01, 0.0)


def _passage_rows(items: DataFrame, vocabulary: dict[str, int], idf: np.ndarray) -> DataFrame:
    """``item``, and ``words`` and ``values`` of the TF-IDF row of each passage."""
    shared = items.sparkSession.sparkContext.broadcast((vocabulary, idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for batch in batches:
            out = []
            for number, text in zip(text_column(batch, "item"), text_column(batch, "text"), strict=True):
                for passage in passages_of(words_of(text)):
                    counts = Counter(known[w] for w in passage)
                    out.append((number, list(counts), [float(n * weight[w]) for w, n in counts.items()]))
            columns = [[r[i] for r in out] for i in range(3)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["item", "words", "values"]
            )

    return arrow_map(items, run, "item long, words array<long>, values array<double>")


def _sparse(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for ids, values in zip(text_column(batch, "words"), text_column(batch, "values"), strict=True):
        x = np.array(values)
        yield np.array(ids, np.int64), x / max(np.linalg.norm(x), 1e-12)


def _gram_times(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """A'(A basis) for the passage matrix A: parts of the product by task, then summed up by blocks of words."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    shape = basis.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for ids, x in _sparse(batch):
                y = x @ shared.value[ids]
                for b in np.unique(ids // ROWS).tolist():
                    mine = ids // ROWS == b
                    np.add.at(total.setdefault(b, np.zeros((ROWS, shape[1]))), ids[mine] % ROWS, np.outer(x[mine], y))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array([m.tobytes() for m in total.values()], pa.binary())], ["block", "part"]
        )

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_py(), np.float64) for p in group.column("part"))
        return pa.table({"block": group.column("block").slice(0, 1), "part": pa.array([total.tobytes()], pa.binary())})

    parts = arrow_map(rows, run, "block long, part binary").groupBy("block").applyInArrow(add, "block long, part binary")
    out = np.zeros((-(-shape[0] // ROWS) * ROWS, shape[1]))
    for block, part in parts.toLocalIterator():
        out[block * ROWS : (block + 1) * ROWS] = np.frombuffer(part, np.float64).reshape(ROWS, -1)
    return out[: shape[0]]


def latent_directions(rows: DataFrame, n_words: int, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors of the passage matrix, as columns, by a randomised range finder."""
    wide = min(rank + OVERSAMPLING, n_words)
    basis = np.random.default_rng(1).standard_normal((n_words, wide))
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(_gram_times(rows, basis))
    values, turn = np.linalg.eigh(basis.T @ _gram_times(rows, basis))
    leading = np.argsort(values)[::-1][:rank]
    leading = leading[values[leading] > 1e-9]
    return basis @ turn[:, leading]


def prepare(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", text: str = "text", docs_text: str = "text") -> list:
    """A ``Retrieval`` for each block of ``ITEMS`` items, broadcast. Repeated items are searched for once; items that are null
    or have fewer than ``LEAST_WORDS`` words are left out."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    n = items.count()
    blocks = max(1, -(-n // ITEMS))
    # Hashing to twice as many blocks as needed keeps each of them near half the bound.
    dealt = saved(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(1 if blocks == 1 else 2 * blocks))), "items")
    out = []
    for block in range(1 if blocks == 1 else 2 * blocks):
        rows = dealt.where(F.col("block") == block).orderBy("item_id", "text").select("item_id", "text").toArrow().to_pylist()
        chosen = [Item.of(r["item_id"], r["text"]) for r in rows]
        kept = [(i, r["text"]) for i, r in zip(chosen, rows, strict=True) if i.size >= LEAST_WORDS]
        if not kept:
            continue
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, t in kept for w in words_of(t)}))}
        df = _frequencies(docs, vocabulary, docs_text)
        idf = _weights(df, [[vocabulary[w] for w in p] for _, t in kept for p in passages_of(words_of(t))])
        numbered = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(kept)], "item long, text string")
        passages = saved(_passage_rows(numbered, vocabulary, idf), "passages")
        directions = latent_directions(passages, len(vocabulary))
        vectors = (idf[:, None] * directions).astype(np.float32)
        table = passages.toArrow()
        counts = [
            (np.array(w), np.array(x)) for w, x in zip(table.column("words").to_pylist(), table.column("values").to_pylist(), strict=True)
        ]
        projected = np.stack([x @ directions[w] for w, x in counts])
        lengths = np.maximum(np.linalg.norm(projected, axis=1, keepdims=True), 1e-12)
        projected = (projected / lengths).astype(np.float32)
        mass = min(float((x * idf[w]).sum()) for w, x in counts)
        weighty = {w: k for w, k in vocabulary.items() if idf[k]}
        found = Retrieval(
            weighty, idf, vectors, projected, lengths[:, 0].astype(np.float32), table.column("item").to_numpy(), [i for i, _ in kept], mass / 4
        )
        out.append(spark.sparkContext.broadcast(found))
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """``id_column``, ``contaminated``, ``n_items``, and ``item_id`` and ``share`` of the item of which most was found.

    One row for each row of ``docs``; null and empty texts are clean. Ties go to the smaller item id. An empty
    benchmark leaves everything clean.
    """
    names = ["n_items", "item_id", "share"]
    item_type = benchmark.schema[item_id].dataType
    schema = docs.select(id_column, F.col(text).alias("text")).schema
    schema = schema.add("n_items", "long").add("item_id", item_type).add("share", "double")
    found = docs.select(
        id_column, F.col(text).alias("text"), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast(item_type).alias("item_id"), F.lit(0.0).alias("share")
    )
    for shared in prepare(docs, benchmark, item_id, "text", text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, items, shares = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)
                for i, found_here in enumerate(shared.value.found_in(text_column(batch, "text"))):
                    for number, share in found_here:
                        n[i] += 1
                        name = shared.value.items[number].item_id
                        if share > shares[i] or share == shares[i] and (items[i] is None or name is not None and name < items[i]):
                            items[i], shares[i] = name, share
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(items, batch.schema.field("item_id").type), pa.array(shares, pa.float64())],
                    batch.schema.names,
                )

        found = arrow_map(found, run, schema)
    return found.select(id_column, (F.col("n_items") > 0).alias("contaminated"), *names)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item of the benchmark was found."""
    for shared in prepare(docs, benchmark, item_id, "text", text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = shared.value.found_in(text_column(batch, text))
                yield batch.filter(pa.array([not here for here in found], pa.bool_()))

        docs = arrow_map(docs, run, docs.schema)
    return docs
