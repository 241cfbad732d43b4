"""SimHash fingerprints of documents and their groups of near copies, found by Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conflux.llm.components import components
from conflux.llm.golay import keys_of_short_words
from conflux.llm.tables import arrow_map, merged, packed, saved, text_column

WORDS = 3
SEED = 42
DISTANCE = 3
SEGMENTS, SEGMENT_BITS = 4, 16
# Fingerprints of a key that one task compares with each other; larger keys are divided.
GROUP = 4096
# Keys of so few fingerprints are compared pair by pair, all keys of a batch at once.
SMALL = 8


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text as an unsigned number: each bit says what most shingles' hashes have; 0 without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[: -words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], ">u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def simhash(docs: DataFrame, text_column_name: str = "text", words: int = WORDS) -> DataFrame:
    """The other columns of ``docs`` and ``fp``, the fingerprint as a signed long, for every row."""
    others = [c for c in docs.columns if c != text_column_name]
    schema = docs.select(others).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in text_column(batch, text_column_name)], np.uint64)
            columns = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(fps.view(np.int64))], schema.names)

    return arrow_map(docs.select(*others, text_column_name), run, schema)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the row each belongs to. Two fingerprints three bits apart or less share a key.

    Segment i of four and the next one in the cycle, j, make a key: all 16 bits of i, and one nearby codeword of j. With three
    errors some segment has none. Such a segment fails only if the next one has two errors or more, which holds for one
    segment at most; if no other segment were free of errors, there would be four.
    """
    table = keys_of_short_words(SEGMENT_BITS)
    parts = fps.view(np.uint64)
    keys, rows = [], []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        whole = (parts >> np.uint64(i * SEGMENT_BITS) & np.uint64(0xFFFF)).astype(np.int64)
        near = table[(parts >> np.uint64(j * SEGMENT_BITS) & np.uint64(0xFFFF)).astype(np.int64)]
        row, which = np.nonzero(near >= 0)
        keys.append(i << 28 | whole[row] << 12 | near[row, which])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys, rows = golay_keys(values)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values[rows])], ["key", "fp"])

    return arrow_map(fps.select("fp"), run, "key long, fp long")


def _forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Edges that connect what links within ``distance`` connect: all of them if they are few, else one for each fingerprint."""
    bits, few = fps.view(np.uint64), ([], [])
    for at in range(0, len(bits), 256):
        near = np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= distance
        i, j = np.nonzero(near)
        ahead = i + at < j
        few[0].extend(fps[i[ahead] + at].tolist())
        few[1].extend(fps[j[ahead]].tolist())
        if len(few[0]) > len(fps):
            break
    else:
        return few
    left, a, b = np.arange(len(fps)), [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            node = front.pop()
            near = np.bitwise_count(bits[left] ^ bits[node]) <= distance
            found = left[near]
            a += [int(fps[node])] * len(found)
            b += fps[found].tolist()
            front += found.tolist()
            left = left[~near]
    return a, b


def _linked(keyed: DataFrame, keys: list[str], distance: int, group: int) -> DataFrame:
    """``u``, ``v``: links that connect the fingerprints of each key; where a key has too many, only ``key`` is set."""

    def of_small(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = [], []
        for shift in range(1, SMALL):
            same = np.flatnonzero((key[shift:] == key[:-shift]).all(axis=1)) if len(key) > shift else np.empty(0, int)
            if not len(same):
                break
            near = same[np.bitwise_count(fp[same].view(np.uint64) ^ fp[same + shift].view(np.uint64)) <= distance]
            a.append(fp[near])
            b.append(fp[near + shift])
        return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u, v, key) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (u, v, key)], ["u", "v", "key"]
            )

        def complete(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            sizes = np.diff(np.append(starts, len(key)))
            few = np.repeat(sizes <= SMALL, sizes)
            u, v = of_small(key[few], fp[few])
            if len(u):
                yield out(u, v, np.full(len(u), None))
            for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                a, b = _forest(fp[at : at + size], distance)
                if a:
                    yield out(a, b, [None] * len(a))

        # Rows come sorted by key; those of the last key of a batch wait for the next batch.
        rest_key, rest_fp, over = np.empty((0, len(keys)), np.int64), np.empty(0, np.int64), None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys))], axis=1)
            fp = batch.column(len(keys)).to_numpy(zero_copy_only=False)
            if over is not None:
                ahead = int(np.argmin(np.append((key == over).all(axis=1), False)))
                key, fp = key[ahead:], fp[ahead:]
                if not len(key):
                    continue
                over = None
            key, fp = np.concatenate((rest_key, key)), np.concatenate((rest_fp, fp))
            if not len(key):
                continue
            open_from = int(np.argmax((key == key[-1]).all(axis=1)))
            if open_from:
                yield from complete(key[:open_from], fp[:open_from])
            rest_key, rest_fp = key[open_from:], fp[open_from:]
            if len(rest_key) > group:
                over = rest_key[-1]
                yield out([None], [None], [int(over[0])])
                rest_key, rest_fp = rest_key[:0], rest_fp[:0]
        if len(rest_key):
            yield from complete(rest_key, rest_fp)

    rows = keyed.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return arrow_map(rows, run, "u long, v long, key long")


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """``u``, ``v``: links of distinct fingerprints (``fp``, long) that connect all those within ``distance`` (3 at most).

    The fingerprints of a key are compared in one task, up to ``group`` of them. A larger key is cut into blocks of its
    fingerprints, and each two of its blocks meet in a task, so no task holds more than two blocks and none is left out.
    """
    if distance > DISTANCE:
        raise ValueError(f"the keys find pairs of up to {DISTANCE} different bits")
    keyed = _keyed(fps)
    found = saved(_linked(keyed, ["key"], distance, group), "simhash-links")
    links = found.where("u is not null").select("u", "v")
    large = found.where("key is not null").select("key").distinct()
    if not large.isEmpty():
        rows = keyed.join(large, "key")
        sizes = rows.groupBy("key").agg(F.ceil(F.count("*") * 4 / group).alias("blocks"))
        block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        cells = rows.join(sizes, "key").withColumn("block", block).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        cells = cells.select(
            F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "key", "fp"
        )
        more = saved(_linked(cells, ["key", "first", "second"], distance, 1 << 30), "simhash-links")
        links = links.unionByName(more.select("u", "v"))
    return links.distinct()


def _grouped(docs: DataFrame, id_column: str, text_column_name: str, words: int) -> tuple[DataFrame, DataFrame]:
    """Rows as ``id``, ``tie`` (a hash of the text), ``fp``; and ``distinct_fp``, ``root``, ``first`` by fingerprint.

    ``first`` is the first row with the fingerprint by ``id``, nulls last, then by ``tie``.
    """
    named = docs.select(F.col(id_column).alias("id"), F.col(text_column_name).alias("text"))
    rows = saved(simhash(named.withColumn("tie", F.xxhash64("text")), words=words), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("first")
    distinct = saved(rows.groupBy("fp").agg(first), "simhash-distinct")
    roots = components(fingerprint_links(distinct))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        F.col("fp").alias("distinct_fp"), "first", F.coalesce("root", "fp").alias("root")
    )
    return rows, saved(rooted, "simhash-roots")


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column_name: str = "text", words: int = WORDS) -> DataFrame:
    """``id_column``, ``fp`` and ``component``, the smallest id reachable over links of at most three different bits.

    One row for each row of ``docs``. Texts that are null, empty or without words have fingerprint 0 and are linked like
    others. A null id never is the smallest; a component that has only null ids has a null. Repeated rows come out repeated.
    """
    rows, rooted = _grouped(docs, id_column, text_column_name, words)
    smallest = rooted.groupBy("root").agg(F.min("first.id").alias("component"))
    groups = saved(rooted.join(smallest, "root").select("distinct_fp", "component"), "simhash-components")
    found = rows.join(groups, rows["fp"] == groups["distinct_fp"])
    return found.select(F.col("id").alias(id_column), "fp", "component")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column_name: str = "text", words: int = WORDS) -> DataFrame:
    """One row of ``docs``, all columns, of each component of ``near_copies``: the one with the smallest id.

    Null ids come last. Of rows with the same id, the one with the smallest text hash stays; of rows that agree in
    id and text, any one. Texts without words are alike, and so are null and empty ones.
    """
    whole = F.coalesce(F.col(f"`{text_column_name}`"), F.lit(""))
    named = docs.select(F.col(f"`{id_column}`").alias("id"), whole.alias("text"))
    rows, rooted = _grouped(named, "id", "text", words)
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    kept = saved(first.select(F.col("first.id").alias("kept_id"), F.col("first.tie").alias("kept_tie")), "simhash-kept")
    tied = packed(docs).withColumn("id", F.col(f"row.`{id_column}`"))
    tied = tied.withColumn("tie", F.xxhash64(F.coalesce(F.col(f"row.`{text_column_name}`"), F.lit(""))))
    same = kept["kept_id"].eqNullSafe(tied["id"]) & (kept["kept_tie"] == tied["tie"])
    left = tied.join(merged(kept), same, "left_semi")
    again = rows.groupBy("id", "tie").count().where("count > 1").select("id", "tie")
    again = saved(again.select(F.col("id").alias("kept_id"), F.col("tie").alias("kept_tie")), "simhash-again")
    if again.isEmpty():
        return left.select("row.*")
    same = again["kept_id"].eqNullSafe(left["id"]) & (again["kept_tie"] == left["tie"])
    single = left.join(again, same, "left_semi").dropDuplicates(["id", "tie"])
    return left.join(again, same, "left_anti").unionByName(single).select("row.*")
