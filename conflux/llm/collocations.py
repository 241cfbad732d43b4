"""Collocations: phrases of two to four words whose parts stand together more than apart, language by language.

Counts of phrases are kept as streams, one row a phrase, sorted once by the words from the first (prefix order) and once by
the words from the last (suffix order). In prefix order a phrase follows all its beginnings and is followed by all its
extensions to the right; one pass with a stack of open phrases reads off both. Suffix order does the same for endings and
extensions to the left. No count is looked up in a hash table or joined but those of single words, by merge joins.

Only frequent phrases are counted as rows. A phrase can be frequent only if all phrases in it are, so longer ones are
counted where a bitmap of the frequent words, then of the frequent pairs, says so. A bitmap has a fixed size;
phrases that fall on one bit let too much through, never too little, and counts are filtered exactly in the end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conflux.llm.tables import arrow_map, merged, saved, text_column

LONGEST, LEAST, TOP = 4, 30, 2000
# A shorter phrase falls away if a longer one around it has this many of 100 of its occurrences.
COVERED = 80
# Bytes of text that a task holds before it hands out their counts.
HELD = 16 << 20
# Bits of the bitmap of frequent phrases; 8 MB.
BITS = 1 << 26

UNKNOWN = "und"
_UPPER = bytes(range(65, 91))
_READ = bytes.maketrans(_UPPER + b".,;:!?\n\x0b\x0c\r\t", _UPPER.lower() + b"\n" * 10 + b" ")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_END = -1


def _numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of texts, and the texts one after the other as numbers of words, with an end after each piece."""
    spaced = pa.array([t.translate(_READ).replace(b"\n", b" \n ") + b" \n" for t in texts], pa.large_binary())
    found = pc.split_pattern(spaced, b" ").flatten().dictionary_encode()
    words, numbers = found.dictionary, found.indices.to_numpy()
    nothing, end = (pc.index(words, pa.scalar(w, words.type)).as_py() for w in (b"", b"\n"))
    numbers = numbers[numbers != nothing]
    numbers[numbers == end] = _END
    return words, numbers


def _bit(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """The bit, of ``bits``, of each phrase whose words' hashes stand in the same place of the arrays."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = (out ^ h) * _MIX
        out ^= out >> np.uint64(29)
    return (out & np.uint64(bits - 1)).astype(np.int64)


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _runs(flags: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` flags in a row are set, from each place on where there are so many."""
    n = max(0, len(flags) - size + 1)
    out = np.ones(n, bool)
    for k in range(size):
        out &= flags[k : k + n]
    return out


def _distinct(text: np.ndarray, at: np.ndarray, size: int, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct phrases of ``size`` words that start at ``at``, as a column for each word, and how often each is there.

    A phrase is the rank of its beginning among the distinct ones, times the number of words, plus its last word.
    """
    code, levels = text[at].astype(np.int64), []
    for k in range(1, size):
        if k > 1:
            levels.append(np.unique(code))
            code = np.searchsorted(levels[-1], code)
        code = code * words + text[at + k]
    distinct, counts = np.unique(code, return_counts=True)
    columns = []
    for _ in range(1, size):
        distinct, last = np.divmod(distinct, words)
        columns.append(last)
        if levels:
            distinct = levels.pop()[distinct]
    return [distinct, *reversed(columns)], counts


def _counts_of(texts: list[bytes], lang: str, sizes: tuple[int, ...], known: tuple[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """The distinct phrases of some sizes in texts and how often each is there.

    ``known`` has a size and a bitmap: phrases count only if all phrases of that size in them are on it.
    """
    words, text = _numbered(texts)
    inside, of = text != _END, 1
    if known is not None:
        of, bitmap = known
        hashes = _word_hashes(words.to_pylist(), lang)
        inside = _runs(inside, of)
        for start in range(0, len(inside), 1 << 18):
            part = slice(start, min(start + (1 << 18), len(inside)))
            bits = _bit([hashes[text[part.start + k : part.stop + k]] for k in range(of)], 8 * len(bitmap))
            inside[part] &= bitmap[bits >> 3] >> (bits & 7) & 1 > 0
    for size in sizes:
        at = np.flatnonzero(_runs(inside, size - of + 1))
        columns, counts = _distinct(text, at, size, len(words))
        parts = [words.take(pa.array(c)).cast(pa.binary()) for c in columns]
        phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ")) if size > 1 else parts[0]
        langs = pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int32)))
        yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(counts)], ["lang", "phrase", "f"])


def _counted(texts: DataFrame, sizes: tuple[int, ...], known: tuple[int, np.ndarray] | None, held: int) -> DataFrame:
    """``lang``, ``phrase``, ``f``: the phrases of these sizes; with a bitmap, only those whose parts are on it."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, list[bytes]] = defaultdict(list)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in read.items():
                for found in _counts_of(parts, lang, sizes, shared.value):
                    for start in range(0, found.num_rows, 1 << 16):
                        yield found.slice(start, 1 << 16)
            read.clear()

        n = 0
        for batch in batches:
            for lang, text in zip(text_column(batch, "lang"), batch.column(1), strict=True):
                read[lang].append(text.as_py())
                n += len(read[lang][-1])
                if n >= held:
                    yield from out()
                    n = 0
        yield from out()

    rows = arrow_map(texts, run, "lang string, phrase binary, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits, a power of two of 64 at least, those of the phrases set, as bytes. At most ``bits`` / 64 rows reach the driver, whatever the number of phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(text_column(batch, "lang"), batch.column(1).to_pylist(), strict=True)
            hashes = [_word_hashes(phrase.split(b" "), lang) for lang, phrase in rows]
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(_bit(list(np.array(hashes).T), bits))], ["bit"])

    set_ = arrow_map(phrases.select("lang", "phrase"), run, "bit long")
    words = set_.groupBy(F.expr("bit div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _along(rows: DataFrame, path: str, single: str, below: str, most: str) -> DataFrame:
    """``rows`` and what a pass over them in the order of their arrays ``path`` tells.

    ``below``: how often each shorter beginning of the path occurs, from one word on; ``single`` has the first of them.
    ``most``: how often the most frequent path with one more word occurs, 0 if there is none.
    Rows with the same first two words come to one task; a path's beginnings are among them, as none of them is less
    frequent than the path. A task holds the open path only, and rows until they make a batch.
    """
    ordered = rows.repartitionByRange("lang", F.col(path)[0], F.col(path)[1]).sortWithinPartitions("lang", path)
    names, schema = rows.columns, f"{_ddl(rows)}, {below} array<long>, {most} long"
    arrow = [(below, pa.list_(pa.int64())), (most, pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        # The open path: each row is the beginning of the next one. An entry is a row, its key, the two results and f.
        open_: list[list] = []

        def out(fields: list) -> pa.RecordBatch:
            columns = [pa.array(column, field[1]) for column, field in zip(zip(*done, strict=True), fields, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, [name for name, _ in fields])

        def close() -> None:
            row, _, before, most_of, _ = open_.pop()
            done.append([*row, before, most_of])

        fields = None
        for batch in batches:
            fields = [*zip(batch.schema.names, batch.schema.types, strict=True), *arrow]
            at = {name: names.index(name) for name in ("lang", path, single, "f")}
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, f = (row[at["lang"]], *row[at[path]]), row[at["f"]]
                while open_ and open_[-1][1] != key[:-1]:
                    close()
                if open_:
                    parent = open_[-1]
                    parent[3] = max(parent[3], f)
                    before = [*parent[2], parent[4]]
                else:
                    before = [row[at[single]]]
                open_.append([row, key, before, 0, f])
            if len(done) >= 4096:
                yield out(fields)
        while open_:
            close()
        if done:
            yield out(fields)

    return arrow_map(ordered, run, schema)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)


def _divided(top: Column, bottom: Column, times: int) -> Column:
    """floor(times * top / bottom), exact: the product has up to 26 digits."""
    wide = top.cast("decimal(19,0)") * F.lit(times).cast("decimal(10,0)")
    return F.call_function("div", wide, bottom.cast("decimal(20,0)"))


def collocations(
    docs: DataFrame,
    text_column_name: str = "text",
    lang_column: str = "lang",
    least: int = LEAST,
    top: int = TOP,
    held: int = HELD,
    bits: int = BITS,
) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the first ``top`` phrases of each language.

    Texts are cut at ``. , ; : ! ?`` and line ends, A-Z lowered; words stand between spaces and tabs. A phrase of two to four words
    is a candidate if it occurs ``a`` >= ``least`` times within such pieces, overlaps included. Cut after any of its words,
    its parts occur ``l`` and ``r`` times; the cut with the least 2,000,000 a / (l + r), rounded down, counts, the first of
    equal ones. A candidate falls away if one of its words more has 80 of 100 of its occurrences. Ties go to the greater a, then
    to the phrase in the order of bytes. ``n`` is the number of words of the language.

    A null text is empty, a null language is ``und``. Repeated rows count again. Very long texts are read whole, in one task.
    An empty table has no phrases.
    """
    lang = F.coalesce(F.col(f"`{lang_column}`"), F.lit(UNKNOWN)).alias("lang")
    texts = docs.where(F.col(f"`{text_column_name}`").isNotNull()).select(lang, F.col(f"`{text_column_name}`").cast("binary").alias("text"))
    words = saved(_counted(texts, (1,), None, held), "collocations-words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = F.col("f") >= least
    singles = words.where(frequent)
    pairs = saved(_counted(texts, (2,), (1, _bitmap(singles, bits)), held).where(frequent), "collocations-pairs")
    sizes = tuple(range(3, LONGEST + 1))
    longer = saved(_counted(texts, sizes, (2, _bitmap(pairs, bits)), held).where(frequent), "collocations-phrases")
    phrases = pairs.unionByName(longer)
    split = F.transform(F.split(F.col("phrase").cast("string"), " ", -1), lambda w: w.cast("binary"))
    phrases = phrases.select("lang", "f", split.alias("words")).withColumn("backwards", F.reverse("words"))
    for end, array in (("first", "words"), ("last", "backwards")):
        alone = merged(singles.select(F.col("lang").alias("of"), F.col("phrase").alias("word"), F.col("f").alias(end)))
        phrases = phrases.join(alone, (F.col("lang") == F.col("of")) & (F.col(array)[0] == F.col("word"))).drop("of", "word")
    seen = _along(phrases, "words", "first", "lefts", "longer")
    seen = _along(seen, "backwards", "last", "rights", "longer_left")
    covered = F.greatest("longer", "longer_left").cast("decimal(19,0)") * 100 >= F.col("f").cast("decimal(19,0)") * COVERED

    def cut(k: Column) -> Column:
        left, right = F.col("lefts")[k], F.col("rights")[F.size("lefts") - 1 - k]
        return F.struct(_divided(F.col("f"), left + right, 2_000_000).alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    cuts = F.transform(F.sequence(F.lit(0), F.size("lefts") - 1), cut)
    spelled = F.array_join(F.transform("words", lambda w: w.cast("string")), " ")
    scored = seen.where(~covered).select("lang", spelled.alias("phrase"), F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
