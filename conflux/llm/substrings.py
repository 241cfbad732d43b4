"""Removal of long strings that occur more than once, documents' bytes taken as one text, by suffix sorting block by block.

Only suffixes that can tie for the whole length are sorted. Of the 64-byte grams in each window of the length, the one with
the least hash is its anchor; equal windows have equal anchors at equal distances. Anchors that stand at one place only are
dropped. The surroundings of the others meet by anchor: they are a bucket of suffixes with a common gram, aligned on it.

A bucket is sorted block by block, a block being the suffixes at one distance from the anchor. For long ties there are ranks
of a cover sample, the positions at multiples of ``COVER`` from the anchor, by prefix doubling. As all suffixes of a block
have the same distance to the anchor, the difference of two of them is a multiple of the period and {0} is a cover: the next
sample position is at the same distance in all. A suffix's first 400 bytes are then the ranks of two overlapping samples and the
16 bytes before and behind them. Memory holds one batch of buckets, its ranks, and the keys of a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflux.llm.tables import arrow_map, chunks, merged, saved, text_column

LENGTH = 400
GRAM = 64
COVER = 16
# Bytes before an anchor that a window with it may start at, and columns of a surrounding: the anchor is at LEFT.
LEFT = LENGTH - GRAM
WIDTH = LEFT + LENGTH
# Rows that are sorted together; a bucket of over HOT rows is worked out by grouping its windows instead, all tasks sharing it.
ROWS, HOT = 16_384, 65_536
CHUNK = 1_000_000
# The most windows whose rows are told by a broadcast list: those with over this part of all rows.
POPULAR = 16_384

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = 28


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the texts in ``data``: each anchor's text, place in it, gram hash, and the first and last window it is the anchor of."""
    if len(data) >> _PLACE:
        raise ValueError(f"a text of {len(data)} bytes is too long: places have {_PLACE} bits")
    terms = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))))
    grams = _mixed((terms[GRAM:] - terms[:-GRAM]) * _powers(_INVERSE, len(data) - GRAM + 1))
    # Sorted by hash, then place: the leftmost of equal ones is the anchor.
    least = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    width, wanted = 1, LENGTH - GRAM + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    long = np.flatnonzero(sizes >= LENGTH)
    counts = sizes[long] - LENGTH + 1
    owner = np.repeat(long, counts)
    window = np.arange(len(owner)) + np.repeat(starts[long] - (np.cumsum(counts) - counts), counts)
    place = (least[window] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(new[1:], len(owner)) - 1
    of, at = owner[new], place[new]
    begin = starts[of]
    return of, at - begin, grams[at].view(np.int64), window[new] - begin, window[last] - begin


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """``t1``, ``t2`` (what a text is known by), ``gram``, ``pos``, ``first``, ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            texts = [_bytes(t) for t in text_column(batch, "text")]
            for a, b in chunks(texts, CHUNK):
                sizes = np.array([len(t) for t in texts[a:b]], np.int64)
                if (sizes < LENGTH).all():
                    continue
                data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
                of, pos, gram, first, last = anchors(data, np.cumsum(sizes) - sizes, sizes)
                columns = (t1[a:b][of], t2[a:b][of], gram, pos, first, last)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["t1", "t2", "gram", "pos", "first", "last"])

    rows = docs.where(F.octet_length("text") >= LENGTH).select("t1", "t2", "text")
    return arrow_map(rows, run, "t1 long, t2 long, gram long, pos long, first long, last long")


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _surroundings(texts: DataFrame) -> DataFrame:
    """For each anchor of ``places``: the bytes around it, and how many of them come before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = (batch.column(i).to_pylist() for i in range(2))
            for i, (text, places) in enumerate(zip(text_column(batch, "text"), text_column(batch, "places"), strict=True)):
                data = _bytes(text)
                rows = [
                    (p["gram"], t1[i], t2[i], p["pos"], p["first"], p["last"], data[max(0, p["pos"] - LEFT) : p["pos"] + LENGTH])
                    for p in places
                ]
                types = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                    ["gram", "t1", "t2", "pos", "first", "last", "around"],
                )

    return arrow_map(texts, run, "gram long, t1 long, t2 long, pos long, first long, last long, around binary")


def _names(*columns: np.ndarray) -> np.ndarray:
    """Ranks of the rows of the columns, in their order: equal rows have equal ranks."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        ordered = c[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(table: np.ndarray) -> np.ndarray:
    """Ranks of the first 256 bytes from each sample position of the rows, by doubling from 16 bytes."""
    n, columns = len(table), WIDTH // COVER
    words = np.ascontiguousarray(table).view(">u8").reshape(n, columns, 2).astype(np.uint64)
    rank = _names(words[:, :, 0].ravel(), words[:, :, 1].ravel()).reshape(n, columns)
    span = 1
    while span * COVER < 256:
        rank = _names(rank[:, :-span].ravel(), rank[:, span:].ravel()).reshape(n, -1)
        span *= 2
    return rank


def repeated_windows(table: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and distance before the anchor of every window whose bytes stand in another row at the same distance too."""
    ranks = cover_ranks(table)
    found_rows, found_distances = [], []
    for distance in range(LEFT + 1):
        start = LEFT - distance
        window = pos - distance
        rows = np.flatnonzero((window >= first) & (window <= last))
        if len(rows) < 2:
            continue
        head = -(-start // COVER) * COVER
        tail = (start + LENGTH) // COVER * COVER
        keys = [ranks[rows, head // COVER], ranks[rows, (tail - 256) // COVER]]
        if head > start:
            rest = np.concatenate((table[rows, start:head], table[rows, tail : start + LENGTH]), axis=1)
            keys += list(np.ascontiguousarray(rest).view(np.uint64).T)
        order = np.lexsort(keys[::-1])
        same = np.ones(len(order) - 1, bool)
        for key in keys:
            ordered = key[order]
            same &= ordered[1:] == ordered[:-1]
        hit = rows[order[np.append(same, False) | np.append(False, same)]]
        found_rows.append(hit)
        found_distances.append(np.full(len(hit), distance))
    if not found_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_rows), np.concatenate(found_distances)


def _laid_out(around: list[bytes], pos: np.ndarray) -> np.ndarray:
    """The surroundings as rows, the anchors below each other; what a text lacks is zero and in none of its windows."""
    table = np.zeros((len(around), WIDTH), np.uint8)
    for i, (data, p) in enumerate(zip(around, pos.tolist(), strict=True)):
        begin = LEFT - min(p, LEFT)
        table[i, begin : begin + len(data)] = np.frombuffer(data, np.uint8)
    return table


def _runs(rows: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((windows, rows))
    rows, windows = rows[order], windows[order]
    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (windows[1:] != windows[:-1] + 1))))
    return rows[new], windows[new], windows[np.append(new[1:], len(rows)) - 1]


def _repeats(around: DataFrame, batch_rows: int) -> DataFrame:
    """Runs of repeated windows, ``begin`` to ``end``. A task holds each of its buckets whole."""

    def solved(t1, t2, pos, first, last, data) -> Iterator[pa.RecordBatch]:
        # A row may be there twice where a document is.
        _, one = np.unique(np.stack((t1, t2, pos)), axis=1, return_index=True)
        t1, t2, pos, first, last = (c[one] for c in (t1, t2, pos, first, last))
        rows, distances = repeated_windows(_laid_out([data[i] for i in one.tolist()], pos), pos, first, last)
        if len(rows):
            rows, begin, end = _runs(rows, pos[rows] - distances)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (t1[rows], t2[rows], begin, end)], ["t1", "t2", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def joined():
            columns = [np.concatenate([h[k] for h in held]) for k in range(6)]
            return columns, [d for h in held for d in h[6]]

        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                columns = [part.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
                data = part.column(6).to_pylist()
                held.append([*columns, data])
                size += len(data)
                if size < batch_rows:
                    continue
                columns, data = joined()
                open_from = int(np.argmax(columns[0] == columns[0][-1]))
                if open_from:
                    yield from solved(*[c[:open_from] for c in columns[1:]], data[:open_from])
                held, size = [[*[c[open_from:] for c in columns], data[open_from:]]], len(data) - open_from
        if size:
            columns, data = joined()
            yield from solved(*columns[1:], data)

    rows = around.repartition("gram").sortWithinPartitions("gram")
    return arrow_map(rows, run, "t1 long, t2 long, begin long, end long")


def _windows(around: DataFrame) -> DataFrame:
    """Every window of the rows by the hash of its bytes, for buckets too large for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                before = min(row["pos"], LEFT)
                starts = range(row["first"], row["last"] + 1)
                cut = [row["around"][before - (row["pos"] - s) :][:LENGTH] for s in starts]
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hashlib.md5(c).digest() for c in cut], pa.binary()),
                        pa.array([row["t1"]] * n),
                        pa.array([row["t2"]] * n),
                        pa.array(list(starts), pa.int64()),
                    ],
                    ["code", "t1", "t2", "at"],
                )

    return arrow_map(around, run, "code binary, t1 long, t2 long, at long")


def repeated_runs(texts: DataFrame, batch_rows: int = ROWS, most: int = HOT) -> DataFrame:
    """``t1``, ``t2``, ``begin``, ``end``: runs of window starts whose 400 bytes stand at another place too.

    ``texts`` has one row for each distinct text, with ``places``, its anchors that stand at two places or more.
    """
    around = _surroundings(texts)
    buckets = texts.select(F.explode("places.gram").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    # Their rows are told where they are, by a broadcast list: it has less than one gram to ``most`` rows.
    hot = saved(buckets.where(F.col("n") > most).select("gram"), "substring-hot")
    if hot.isEmpty():
        return saved(_repeats(around, batch_rows), "substring-runs")
    runs = saved(_repeats(around.join(F.broadcast(hot), "gram", "left_anti"), batch_rows), "substring-runs")
    windows = saved(_windows(around.join(F.broadcast(hot), "gram", "left_semi")), "substring-windows")
    place = F.struct("t1", "t2", "at")
    ends = windows.groupBy("code").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
    twice = saved(ends.where("a <> b").select("code", "n"), "substring-codes")
    # Each of these windows has so large a part of all rows that there can be no more than POPULAR of them: their rows are told
    # where they are. All others are few for each window.
    often = F.broadcast(twice.where(F.col("n") > windows.count() // POPULAR).select("code"))
    others = windows.join(often, "code", "left_anti").join(merged(twice.select("code")), "code", "left_semi")
    more = windows.join(often, "code", "left_semi").unionByName(others).distinct()
    return runs.unionByName(more.select("t1", "t2", F.col("at").alias("begin"), F.col("at").alias("end")))


def _cut(texts: DataFrame) -> DataFrame:
    """What is left of each text without the windows of its ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(text_column(batch, "text"), text_column(batch, "runs"), strict=True):
                data, kept, at, removed, spans = _bytes(text), [], 0, 0, 0
                for begin, end in sorted((r["begin"], r["end"] + LENGTH) for r in runs):
                    if begin > at or not spans:
                        kept.append(data[at:begin])
                        spans += 1
                        at = begin
                    removed += max(0, end - at)
                    at = max(at, end)
                kept.append(data[at:])
                out.append((removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            types = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                ["c1", "c2", "n_removed", "n_spans", "kept_sha256"],
            )

    return arrow_map(texts, run, "c1 long, c2 long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", batch_rows: int = ROWS, most: int = HOT
) -> DataFrame:
    """``id_column``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` of every row: what is left of its bytes without those
    covered by a string of 400 bytes that also starts anywhere else, in any row. Null texts count as empty.

    A text of 2^28 bytes or more is refused, as a task holds a text whole. Equal texts are worked out once; if there are two of them, all of a text of 400 bytes or more goes. Texts are known by two
    64-bit hashes.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_column).alias("id"), whole.alias("text"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("second"), F.reverse("text"))})
    found = saved(_anchor_rows(rows), "substring-anchors")
    place = F.struct("t1", "t2", "pos")
    twice = found.groupBy("gram").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("gram")
    met = found.join(saved(twice, "substring-grams"), "gram", "left_semi")
    places = met.groupBy("t1", "t2").agg(F.collect_set(F.struct("gram", "pos", "first", "last")).alias("places"))
    facts = rows.select("id", "t1", "t2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    facts = saved(facts, "substring-facts")
    classes = facts.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    # One row of each text is enough; rows with the same id and text count once later on.
    chosen = places.join(classes, ["t1", "t2"]).select(
        F.col("t1").alias("c1"), F.col("t2").alias("c2"), "least", "copies", "places"
    )
    chosen = saved(chosen, "substring-chosen")
    same = (rows["t1"] == chosen["c1"]) & (rows["t2"] == chosen["c2"]) & rows["id"].eqNullSafe(chosen["least"])
    texts = saved(rows.join(merged(chosen), same).select("t1", "t2", "text", "places", "copies"), "substring-texts")
    runs = repeated_runs(texts.select("t1", "t2", "text", "places"), batch_rows, most)
    runs = runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    once = texts.where("copies = 1").select("t1", "t2", "text")
    cut = saved(_cut(once.join(runs, ["t1", "t2"]).select("t1", "t2", "text", "runs")), "substring-cut")
    alone = classes.where("copies > 1").select(F.col("t1").alias("d1"), F.col("t2").alias("d2"), F.lit(True).alias("copied"))
    out = facts.join(cut, (facts["t1"] == cut["c1"]) & (facts["t2"] == cut["c2"]), "left")
    out = out.join(alone, (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2")), "left")
    gone = F.col("copied").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return out.select(
        F.col("id").alias(id_column),
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
