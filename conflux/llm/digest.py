"""Digests of documents from improbable features, for telling how much of one is in another.

Each window of bytes is ranked by how far its entropy is from what is usual in text. Windows that are the rarest of their
neighbourhood often enough are features. They are hashed into a chain of Bloom filters, a new one after every so many
features, and two digests are compared by the overlap of their filters' bits, beyond what chance would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conflux.llm.tables import arrow_map, chunks, saved, text_column

WINDOW = 16
# A window is a feature if it is the rarest of so many neighbourhoods of SPAN windows in a row. A text too short for that has
# its rarest window. A longer text that holds a shorter one has all of its neighbourhoods, so its voted features too.
SPAN, POPULAR = 32, 8
# Entropy, in bits a byte, of a usual window of text; below LEAST_ENTROPY a window is all repetition and tells little.
TYPICAL, LEAST_ENTROPY = 3.2, 1.0
FILTER_BITS, FEATURES, HASHES = 2048, 160, 5
CHUNK = 1_000_000

_SCALE = 1 << 16
_COUNT_BITS = np.array([0, *[round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 2)]], np.int64)
_STEP = np.diff(_COUNT_BITS)
_FAR = 1 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _rarity(data: np.ndarray) -> np.ndarray:
    """For each window, how usual its entropy is: small numbers are rare. Exact, as counts and their steps are whole numbers."""
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    # The next window loses its first byte and gains one behind its last.
    start = int(_COUNT_BITS[np.bincount(data[:WINDOW])].sum())
    steps = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
    repeated = np.concatenate(([start], start + np.cumsum(steps)))
    entropy = int(np.log2(WINDOW)) * _SCALE - repeated // WINDOW
    rank = _FAR - np.abs(entropy - int(TYPICAL * _SCALE))
    return np.where(entropy < LEAST_ENTROPY * _SCALE, 2 * _FAR, rank)


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the features, in order, and the text each is in. Texts are at least a window long."""
    key = _rarity(data) << 40 | np.arange(len(data) - WINDOW + 1)
    windows = ends - starts - WINDOW + 1
    least = key.copy()
    width = 1
    while width < SPAN:
        least[:-width] = np.minimum(least[:-width], least[width:])
        width *= 2
    places = (1 << 40) - 1
    # The neighbourhoods inside a text.
    last = np.where(windows >= SPAN, ends - WINDOW - SPAN + 1, starts - 1)
    marks = np.zeros(len(key) + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, last + 1, -1)
    inside = np.cumsum(marks[:-1]) > 0
    votes = np.bincount(least[inside] & places, minlength=len(key))
    chosen = votes >= POPULAR
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        part = slice(s, e - WINDOW + 1)
        if not chosen[part].any():
            chosen[int(key[part].min() & places)] = True
    at = np.flatnonzero(chosen)
    return at, np.searchsorted(starts, at, side="right") - 1


def digests(texts: list[bytes]) -> list[np.ndarray]:
    """The filters of each text, as rows of bytes; none for an empty text. One shorter than a window is padded with zeros."""
    out = [np.empty((0, FILTER_BITS // 8), np.uint8)] * len(texts)
    for a, b in chunks(texts, CHUNK):
        kept = [i for i in range(a, b) if texts[i]]
        if not kept:
            continue
        padded = [texts[i].ljust(WINDOW, b"\0") for i in kept]
        ends = np.cumsum([len(t) for t in padded])
        starts = ends - np.array([len(t) for t in padded])
        data = np.frombuffer(b"".join(padded), np.uint8)
        at, owner = _features(data, starts, ends)
        words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].view(np.uint64)
        hashed = np.zeros(len(at), np.uint64)
        for k in range(words.shape[1]):
            hashed = (hashed ^ words[:, k]) * _MIX[k % len(_MIX)]
            hashed ^= hashed >> np.uint64(29)
        first = np.searchsorted(owner, np.arange(len(kept)))
        counts = np.diff(np.append(first, len(owner)))
        n_filters = -(-counts // FEATURES)
        base = np.cumsum(n_filters) - n_filters
        which = base[owner] + (np.arange(len(owner)) - first[owner]) // FEATURES
        bits = np.zeros((int(n_filters.sum()), FILTER_BITS), bool)
        for k in range(HASHES):
            bits[which, (hashed >> np.uint64(9 + 11 * k) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
        filters = np.packbits(bits, axis=1)
        for i, start, n in zip(kept, base.tolist(), n_filters.tolist(), strict=True):
            out[i] = filters[start : start + n]
    return out


def _contained(a: np.ndarray, b: np.ndarray) -> float:
    """How much of the filters of ``a`` is in those of ``b``: the best match of each, weighed by its bits."""
    in_a = np.bitwise_count(a).sum(axis=1, dtype=np.int64)
    in_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    best = np.zeros(len(a))
    wide = b.view(np.uint64)
    for i, row in enumerate(a.view(np.uint64)):
        common = np.bitwise_count(wide & row).sum(axis=1, dtype=np.int64)
        chance = in_a[i] * in_b / FILTER_BITS
        chance = chance + 2 * np.sqrt(chance * (1 - in_b / FILTER_BITS))
        most = np.minimum(in_a[i], in_b)
        best[i] = np.clip((common - chance) / np.maximum(most - chance, 1e-9), 0, 1)[most > chance].max(initial=0.0)
    return float((best * in_a).sum() / in_a.sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """From 0 to 1: the smaller digest's part that is in the other; of two of one size, the mean of both ways."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if np.array_equal(a, b):
        return 1.0
    if len(a) == len(b):
        return (_contained(a, b) + _contained(b, a)) / 2
    return _contained(a, b) if len(a) < len(b) else _contained(b, a)


def _encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(texts: list[str]) -> tuple[list, ...]:
    """For each text but the last, with the one after it: length, edited text's hash, both fingerprints, likenesses."""
    changed = [_encoded(edited(t, f)) for t, f in zip(texts, texts[1:], strict=False)]
    own, other = digests([_encoded(t) for t in texts]), digests(changed)
    written = [base64.b64encode(d.tobytes()).decode() for d in own]
    n = range(len(changed))
    return (
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(c).hexdigest() for c in changed],
        written[:-1],
        [base64.b64encode(d.tobytes()).decode() for d in other],
        [likeness(own[i], other[i]) for i in n],
        [likeness(own[i], own[i + 1]) for i in n],
    )


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_next(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Digest of each text and of the text edited with the next one's beginning, and how like they are.

    One row for each row of ``docs``. The order is by id, then text hash, nulls last; the first text follows the last. Null texts
    count as empty. Empty digests are alike and unlike all others. A task has a range of the ids; its first and last document
    are put together with those of its neighbours afterwards.
    """
    names = [x.split()[0] for x in _RESULT.split(", ")]
    id_field = docs.select(F.col(id_column).alias("id")).schema
    schema = id_field
    for x in _RESULT.split(", "):
        schema = schema.add(*x.split())
    schema = schema.add("part", "integer").add("edge", "string").add("text", "string")

    def out(batch_schema, ids, columns, part=None, edge=None, texts=None) -> pa.RecordBatch:
        n = len(ids)
        columns = columns or [[None] * n] * len(names)
        types = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
        arrays = [pa.array(ids, batch_schema.field("id").type)]
        arrays += [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        arrays += [pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(texts or [None] * n, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["id", *names, "part", "edge", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            ids, texts = text_column(batch, "id"), [t or "" for t in text_column(batch, "text")]
            if not ids:
                continue
            if last is None:
                yield out(batch.schema, ids[:1], None, part, "first", texts[:1])
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            for a, b in chunks(texts[:-1], CHUNK):
                yield out(batch.schema, ids[a:b], compared(texts[a : b + 1]))
            last, batch_schema = (ids[-1], texts[-1]), batch.schema
        if last is not None:
            yield out(batch_schema, [last[0]], None, part, "last", [last[1]])

    def run_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = text_column(batch, "id")
            pairs = zip(text_column(batch, "text"), text_column(batch, "following"), strict=True)
            found = [[column[0] for column in compared([t, f])] for t, f in pairs]
            yield out(batch.schema, ids, [list(c) for c in zip(*found, strict=True)] if found else None)

    order = [F.col("id").asc_nulls_last(), F.xxhash64("text").asc()]
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = saved(arrow_map(rows, run, schema), "digests")
    # Two rows for each task of the first pass.
    firsts = found.where("edge = 'first'").select(F.col("part").alias("first_part"), F.col("text").alias("following"))
    ordered = Window.orderBy("first_part")
    firsts = firsts.select(
        F.lag("first_part").over(ordered).alias("after"), F.max("first_part").over(Window.partitionBy()).alias("end"), "following"
    ).select(F.coalesce("after", "end").alias("after"), "following")
    edges = found.where("edge = 'last'").select("id", "part", "text").join(firsts, F.col("part") == F.col("after"))
    done = found.where("edge is null").unionByName(arrow_map(edges.select("id", "text", "following"), run_edges, schema))
    return done.select(F.col("id").alias(id_column), *names)
