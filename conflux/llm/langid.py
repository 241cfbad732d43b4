"""Language identification by error-correcting output codes over character n-grams.

Each language has a codeword of +1 and -1. For each bit a binary classifier tells the languages that have +1 there from the
others, by the log ratio of their byte trigrams' shares. A text's margins, one per bit, are compared with all codewords: the
language with the least weighted logistic loss is the prediction; a text whose two best languages are close is ambiguous.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflux.llm.tables import arrow_map, text_column

BUCKETS = 1 << 16
PIECE = 250_000
UNDETERMINED = "und"
# How steeply the loss falls with a margin that is 1 on average, and the probability ratio of the two best languages below
# which a text is ambiguous.
STEEPNESS, SHARPNESS, AMBIGUOUS = 3.0, 4.0, 1.25
# Languages up to which the code is exhaustive: all ways of dividing them in two.
EXHAUSTIVE = 6

_LETTER = re.compile(r"[^\W\d_]")
# Bytes below 128 that are not letters count as spaces.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of +1 and -1 as rows; no column is constant."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        rest = [c for c in product((1, -1), repeat=n - 1) if -1 in c]
        return np.array([(1, *c) for c in rest], np.int8).T
    draw = np.random.default_rng(n)
    best = None
    for _ in range(200):
        code = draw.choice(np.array([1, -1], np.int8), size=(n, 10 * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = int((code[:, None, :] != code[None, :, :]).sum(axis=2)[~np.eye(n, dtype=bool)].min())
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """Trigram buckets of each text, piece by piece, so that a very long text needs no more memory than others."""
    for i, text in enumerate(texts):
        if not text:
            continue
        data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(_SPACED) + b" "
        for at in range(0, max(1, len(data) - 2), PIECE):
            b = np.frombuffer(data, np.uint8, min(PIECE + 2, len(data) - at), at).astype(np.uint32)
            yield i, ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _joined(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Several texts' pieces at a time: text numbers, where each starts, and the buckets."""
    held, size = [], 0
    for i, grams in _pieces(texts):
        held.append((i, grams))
        size += len(grams)
        if size >= PIECE:
            yield _together(held)
            held, size = [], 0
    if held:
        yield _together(held)


def _together(held):
    lengths = [len(g) for _, g in held]
    return np.array([i for i, _ in held]), np.cumsum([0, *lengths[:-1]]), np.concatenate([g for _, g in held])


@dataclass(frozen=True)
class LanguageModel:
    labels: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and whether it is ambiguous; a null or a text without a letter is undetermined."""
        lettered = np.array([bool(t and _LETTER.search(t)) for t in texts], bool)
        if not self.labels:
            lettered[:] = False
        sums, grams = np.zeros((len(texts), self.code.shape[1])), np.zeros(len(texts))
        for rows, starts, buckets in _joined([t if ok else None for t, ok in zip(texts, lettered, strict=True)]):
            np.add.at(sums, rows, np.add.reduceat(self.weights[buckets], starts, axis=0))
            np.add.at(grams, rows, np.diff(np.append(starts, len(buckets))))
        margins = sums / np.maximum(grams, 1)[:, None] / self.scale
        loss = np.logaddexp(0, -STEEPNESS * margins[:, None, :] * self.code[None, :, :]) @ self.trust
        odds = np.exp(-SHARPNESS * (loss - loss.min(axis=1, initial=np.inf, keepdims=True)))
        best = loss.argmin(axis=1) if self.labels else np.zeros(len(texts), int)
        score = np.where(lettered, 1 / np.maximum(odds.sum(axis=1), 1), 0.0)
        second = np.sort(odds, axis=1)[:, -2] if len(self.labels) > 1 else np.zeros(len(texts))
        names = [self.labels[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        return names, score, lettered & (second * AMBIGUOUS > 1)


def gram_counts(labelled: DataFrame, text: str = "text", label: str = "lang") -> DataFrame:
    """``label``, ``bucket``, ``n``: how often each trigram bucket occurs in the texts of each label; null labels are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = text_column(batch, label), text_column(batch, text)
            for rows, starts, buckets in _joined(texts):
                ends = np.append(starts[1:], len(buckets))
                for i, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    if names[i] not in counts:
                        counts[names[i]] = np.zeros(BUCKETS, np.int64)
                    np.add.at(counts[names[i]], buckets[a:b], 1)
        for name, n in counts.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(n[used])], ["label", "bucket", "n"]
            )

    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(label, text)
    each = arrow_map(rows, run, "label string, bucket long, n long")
    return each.groupBy("label", "bucket").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> LanguageModel:
    """A model from all labelled texts. What reaches the driver is a row per label and bucket, whatever the number of texts."""
    found = gram_counts(labelled, text, label).toArrow()
    names = np.array(found.column("label").to_pylist(), dtype=object)
    labels = sorted(set(names.tolist()))
    code = codewords(len(labels))
    shares = np.full((len(labels), BUCKETS), 0.5)
    buckets, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    for i, name in enumerate(labels):
        shares[i, buckets[names == name]] += n[names == name]
    shares /= shares.sum(axis=1, keepdims=True)
    weights = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for bit in range(code.shape[1] if len(labels) > 1 else 0):
        yes = code[:, bit] > 0
        weights[:, bit] = np.log(shares[yes].mean(axis=0)) - np.log(shares[~yes].mean(axis=0))
    expected = (shares @ weights) * code
    scale = np.maximum(expected.mean(axis=0), 1e-9) if labels else np.ones(code.shape[1])
    trust = np.clip(expected.min(axis=0, initial=np.inf) / scale, 0.1, 1.0)
    return LanguageModel(labels, code, weights, scale, trust / trust.sum())


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column``, ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` of every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0; so is everything if the model knows no language.
    """
    schema = docs.select(id_column).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, unsure = shared.value.predict(text_column(batch, text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(unsure)], schema.names
            )

    return arrow_map(docs.select(id_column, text), run, schema)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is determined and not ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, unsure = shared.value.predict(text_column(batch, text))
            yield batch.filter(pa.array([n != UNDETERMINED and not u for n, u in zip(names, unsure.tolist(), strict=True)]))

    return arrow_map(docs, run, docs.schema)
