"""Near copies among vectors of the same label: inverted lists, product-quantised residuals, exact cosines at the end.

Vectors are compared as unit vectors, turned by a fixed rotation that spreads what differs over all components: a cosine
of c or more is a distance of at most sqrt(2 - 2 c). The components are cut into ``SEGMENTS``; two linked vectors are within
half that distance in one of four segments. For each segment a vector is entered in the list of its part's nearest
centroid and in each list whose border is within half of what is allowed there. The point midway between the two parts is
nearest to some centroid, and neither part is further than that from the border of its list, so both vectors are in it:
these probes are sufficient, and no link is lost.

Within a list, a table of distances between the pieces of a vector and the codebooks gives its distance to each coded
vector; as the error of each code is known, this bounds the true distance from below, and only pairs that may be near enough
have their cosine worked out, in double precision. In the list's own segment, codes are of what is left without the
list's centroid.

The index is fitted on a bounded sample (``SAMPLE`` vectors and ``SAMPLE_BYTES`` at most); every vector is entered in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conflux.llm.components import components
from conflux.llm.tables import arrow_map, saved

SIMILAR = 0.98
# Vectors and bytes that the centroids and codebooks are fitted on.
SAMPLE, SAMPLE_BYTES = 1 << 16, 64 << 20
# Parts of a vector, each with lists of its own.
SEGMENTS = 4
# Vectors that a list is meant for, and the most lists of a segment.
LIST, MOST_LISTS = 512, 4096
# Components of a piece that gets a code, and codes of a piece.
PIECE, CODES = 2, 16
ROUNDS = 8
# Vectors of a list that one task compares with each other, or with as many others; longer lists are divided.
BLOCK = 512
# What rounding may add to a distance.
SLACK = 1e-4


@dataclass
class Index:
    """For each segment its centroids; codebooks of pieces as they are, and of pieces less their segment's centroid."""

    rotation: np.ndarray
    centroids: list[np.ndarray]
    whole: np.ndarray
    rest: np.ndarray

    @property
    def size(self) -> int:
        return len(self.rotation)

    @property
    def width(self) -> int:
        return self.size // SEGMENTS

    def turned(self, vectors: np.ndarray) -> np.ndarray:
        """Unit vectors, padded and turned."""
        unit = units(vectors)
        return unit @ self.rotation[: unit.shape[1]]

    def of(self, entry: int) -> tuple[int, np.ndarray]:
        """Segment and centroid of a list."""
        segment, at = divmod(entry, MOST_LISTS)
        return segment, self.centroids[segment][at]

    def frame(self, segment: int) -> np.ndarray:
        """The codebooks in use in the lists of a segment: one for each piece."""
        pieces = self.width // PIECE
        own = slice(segment * pieces, (segment + 1) * pieces)
        out = self.whole.copy()
        out[own] = self.rest[own]
        return out


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; no row may be zero."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate(
        [(centres @ part.T * -2 + (centres**2).sum(axis=1)[:, None]).argmin(axis=0) for part in np.array_split(rows, len(rows) // 8192 + 1)]
    )


def _means(rows: np.ndarray, n: int, spherical: bool = False) -> np.ndarray:
    """``n`` centres of ``rows``: rounds of nearest centre and mean, from evenly spaced rows on. A centre without rows stays."""
    centres = rows[np.linspace(0, len(rows) - 1, n).astype(np.int64)].copy()
    for _ in range(ROUNDS):
        nearest = _nearest(rows, centres)
        order = np.argsort(nearest, kind="stable")
        own, starts = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(rows[order], starts, axis=0)
        if spherical:
            norms = np.linalg.norm(sums, axis=1)
            centres[own[norms > 0]] = sums[norms > 0] / norms[norms > 0, None]
        else:
            centres[own] = sums / np.diff(np.append(starts, len(rows)))[:, None]
    return centres


def fit(sample: np.ndarray, lists: int) -> Index:
    """An index of ``lists`` lists for each segment, or as many as the sample bears, from unit vectors."""
    unit = SEGMENTS * PIECE
    size = -(-sample.shape[1] // unit) * unit
    rotation = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))[0]
    turned = sample @ rotation[: sample.shape[1]]
    lists = max(1, min(lists, MOST_LISTS, len(sample) // 8))
    centroids, rest = [], np.empty_like(turned)
    for s in range(SEGMENTS):
        part = slice(s * size // SEGMENTS, (s + 1) * size // SEGMENTS)
        centroids.append(_means(turned[:, part], lists))
        rest[:, part] = turned[:, part] - centroids[s][_nearest(turned[:, part], centroids[s])]

    def books(rows: np.ndarray) -> np.ndarray:
        pieces = rows.reshape(len(rows), -1, PIECE)[: 1 << 13]
        return np.stack([_means(np.ascontiguousarray(pieces[:, k]), CODES) for k in range(pieces.shape[1])])

    return Index(rotation, centroids, books(turned), books(rest))


def probes(parts: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and lists: the list of each part's nearest centroid, and those whose border is within ``reach``."""
    squares = (centroids**2).sum(axis=1)
    behind = squares - 2 * parts @ centroids.T
    best = behind.argmin(axis=1)
    behind -= behind[np.arange(len(behind)), best][:, None]
    between = np.sqrt(np.maximum(squares[:, None] + squares - 2 * centroids @ centroids.T, 0))[best]
    return np.nonzero(behind <= 2 * (reach + SLACK) * between + SLACK)


def encoded(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of each piece of the rows, and how far off it is, squared."""
    pieces = rows.reshape(len(rows), len(books), PIECE).transpose(1, 0, 2)
    apart = (books**2).sum(axis=2)[:, None, :] - 2 * pieces @ books.transpose(0, 2, 1)
    codes = apart.argmin(axis=2)
    off = ((pieces - np.take_along_axis(books, codes[:, :, None], axis=1)) ** 2).sum(axis=2)
    return codes.T.astype(np.uint8), off.T


def table_distances(rows: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Distances from coded vectors (rows) to vectors (columns), by tables of the vectors' distances to each code."""
    pieces = rows.reshape(len(rows), len(books), PIECE).transpose(1, 2, 0)
    tables = (books**2).sum(axis=2)[:, :, None] - 2 * books @ pieces + (pieces**2).sum(axis=1)[:, None, :]
    tables = tables.astype(np.float32)
    out = np.zeros((len(codes), len(rows)), np.float32)
    for k in range(len(books)):
        out += tables[k][codes[:, k]]
    return np.sqrt(np.maximum(out, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of equal length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _entries(turned: np.ndarray, index: Index, reach: float) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """For each list that each vector is in: the row, the list, the code and its error; sorted by row."""
    codes, off = encoded(turned, index.whole)
    pieces, rows, lists, spelled, errors = index.width // PIECE, [], [], [], []
    for s, centroids in enumerate(index.centroids):
        part, own = slice(s * index.width, (s + 1) * index.width), slice(s * pieces, (s + 1) * pieces)
        row, of = probes(turned[:, part], centroids, reach)
        mine, mine_off = encoded(turned[row, part] - centroids[of], index.rest[own])
        whole = codes[row]
        whole[:, own] = mine
        rows.append(row)
        lists.append(of + s * MOST_LISTS)
        spelled += [c.tobytes() for c in whole]
        errors.append(np.sqrt(off[row].sum(axis=1) - off[row, own].sum(axis=1) + mine_off.sum(axis=1)))
    row, of, error = np.concatenate(rows), np.concatenate(lists), np.concatenate(errors)
    order = np.argsort(row, kind="stable")
    return row[order], of[order], [spelled[i] for i in order.tolist()], error[order]


def _entered(nodes: DataFrame, index, similar: float) -> DataFrame:
    """``nodes`` with ``entries``: the lists each vector is in, in order, with its code and the code's error there."""
    # Half of what two linked vectors may be apart in their nearest segment.
    reach = np.sqrt(max(0.0, 2 - 2 * similar)) / np.sqrt(SEGMENTS) / 2
    entry = pa.struct([("list", pa.int32()), ("code", pa.binary()), ("off", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                vectors = batch.column(batch.schema.get_field_index("vec"))
                sizes = np.diff(vectors.offsets.to_numpy())
                found: list[list] = [[]] * len(vectors)
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    turned = index.value.turned(_matrix(vectors.take(pa.array(rows))))
                    row, of, codes, off = _entries(turned, index.value, reach)
                    spelled = [{"list": c, "code": k, "off": o} for c, k, o in zip(of.tolist(), codes, off.tolist(), strict=True)]
                    bounds = np.searchsorted(row, np.arange(len(rows) + 1))
                    for i, a, b in zip(rows.tolist(), bounds[:-1], bounds[1:], strict=True):
                        found[i] = spelled[a:b]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(entry))], [*batch.schema.names, "entries"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return arrow_map(nodes, run, f"{fields}, entries array<struct<list int, code binary, off double>>")


@dataclass
class _Cell:
    """The vectors of one list, or of two blocks of one."""

    at: int
    nodes: np.ndarray
    copies: np.ndarray
    second: np.ndarray
    vectors: np.ndarray
    codes: np.ndarray
    off: np.ndarray
    lists: list[list[int]]

    def links(self, index: Index, similar: float, divided: bool) -> tuple[np.ndarray, np.ndarray]:
        """Whether each two vectors are linked, and whether this list is the first that has both.

        Of a divided list, only pairs of different blocks.
        """
        segment, centroid = index.of(self.at)
        turned = index.turned(self.vectors)
        turned[:, segment * index.width : (segment + 1) * index.width] -= centroid
        books, n = index.frame(segment), len(turned)
        allowed = (self.off + np.sqrt(max(0.0, 2 - 2 * similar)) + SLACK).astype(np.float32)[:, None]
        near = np.zeros((n, n), bool)
        for start in range(0, n, 64):
            # Each pair is looked up once: those before this block have met it already.
            near[start:, start : start + 64] = table_distances(turned[start : start + 64], self.codes[start:], books) <= allowed[start:]
        near = np.tril(near)
        near |= near.T
        if divided:
            near &= self.second[:, None] != self.second[None, :]
        np.fill_diagonal(near, False)
        rows = np.flatnonzero(near.any(axis=1))
        linked, own = np.zeros((n, n), bool), np.zeros((n, n), bool)
        if len(rows):
            # Cosines of those that have a candidate at all, as scalar products over products of lengths.
            plain = self.vectors[rows].astype(np.float64)
            plain /= np.abs(plain).max(axis=1, keepdims=True)
            length = np.sqrt((plain * plain).sum(axis=1))
            cosines = (plain @ plain.T) / (length[:, None] * length[None, :])
            linked[np.ix_(rows, rows)] = (cosines >= similar) & near[np.ix_(rows, rows)]
            linked |= linked.T
            before = sorted({c for r in rows.tolist() for c in self.lists[r] if c < self.at})
            place = {c: k for k, c in enumerate(before)}
            member = np.zeros((len(rows), len(before)), np.float32)
            for k, r in enumerate(rows.tolist()):
                member[k, [place[c] for c in self.lists[r] if c < self.at]] = 1
            own[np.ix_(rows, rows)] = member @ member.T == 0
        return linked, own


def forest(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what the symmetric matrix ``linked`` connects, one for each row at most."""
    left, a, b = set(np.flatnonzero(linked.any(axis=1)).tolist()), [], []
    while left:
        front = [left.pop()]
        while front:
            node = front.pop()
            found = left.intersection(np.flatnonzero(linked[node]).tolist())
            a += [node] * len(found)
            b += found
            front += found
            left -= found
    return a, b


def _compared(cells: DataFrame, index, similar: float) -> DataFrame:
    """``node``, ``links``: how many vectors a node is linked to, by cell; and ``u``, ``v``: edges that connect what links do."""
    keys = ["label", "size", "list", "first", "second"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            column = {name: table.column(name).combine_chunks() for name in table.schema.names}
            vectors = _matrix(column["vec"])
            codes = np.frombuffer(b"".join(column["code"].to_pylist()), np.uint8).reshape(len(vectors), -1)
            number = {name: column[name].to_numpy(zero_copy_only=False) for name in ("node", "copies", "block", "off")}
            first = {name: column[name][0].as_py() for name in keys}
            lists = column["lists"].to_pylist()
            cell = _Cell(first["list"], number["node"], number["copies"], number["block"], vectors, codes, number["off"], lists)
            linked, own = cell.links(index.value, similar, first["first"] != first["second"])
            links = (linked & own) @ cell.copies
            a, b = forest(linked)
            some = np.flatnonzero(links)
            none = [None] * len(some)
            nodes, counts = cell.nodes[some].tolist(), links[some].tolist()
            u, v = cell.nodes[a].tolist(), cell.nodes[b].tolist()
            columns = [nodes + [None] * len(u), counts + [None] * len(u), none + u, none + v]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "u", "v"])

        # Rows come sorted by cell; the last cell of a batch waits for the next batch.
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys], axis=1)
            if rest:
                last = np.array([rest[-1].column(rest[-1].schema.get_field_index(k))[-1].as_py() for k in keys])
                if (key[0] != last).any():
                    yield out(pa.Table.from_batches(rest))
                    rest = []
            starts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            bounds = [0, *starts.tolist(), batch.num_rows]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rest.append(batch.slice(a, b - a))
                if b < batch.num_rows:
                    yield out(pa.Table.from_batches(rest))
                    rest = []
        if rest:
            yield out(pa.Table.from_batches(rest))

    rows = cells.repartition(*keys).sortWithinPartitions(*keys)
    return arrow_map(rows, run, "node long, links long, u long, v long")


def _usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def embedding_copies(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    similar: float = SIMILAR,
    list_size: int = LIST,
    block: int = BLOCK,
) -> DataFrame:
    """``id_column``, ``n_links``, ``component_id``, ``kept``: one row for each row of ``rows``.

    Two vectors are linked if their labels are equal and not null, they have the same number of components and their
    cosine is ``similar`` or more. ``n_links`` counts the other rows a row is linked to; ``component_id`` is the smallest id
    reachable, its own included; ``kept`` says whether it is its own. All such links are found.

    Vectors that are null, zero, empty, or hold a null or a component that isn't finite are linked to nothing, nor are rows
    with a null label. Rows with the same vector and label are linked and compared with others once for all. A null id is
    linked like others, is never the smallest, and isn't kept; if no id is reachable, the component is null.
    """
    vector, label = F.col(f"`{vector_column}`"), F.col(f"`{label_column}`")
    use = _usable(vector) & label.isNotNull()
    named = rows.select(F.col(f"`{id_column}`").alias("id"), use.alias("use"), vector.alias("vec"), label.alias("label"))
    key = F.struct(F.xxhash64("label", "vec").alias("k1"), F.hash("vec", "label").alias("k2"))
    named = named.withColumn("key", F.when(F.col("use"), key))
    distinct = named.where("use").groupBy("key").agg(
        F.first("vec").alias("vec"), F.first(F.xxhash64("label")).alias("label"), F.count("*").alias("copies"), F.min("id").alias("least")
    )
    distinct = distinct.withColumn("size", F.size("vec")).withColumn("node", F.monotonically_increasing_id())
    nodes = saved(distinct, "embedding-nodes")
    index = _fitted(nodes, list_size)
    if index is None:
        found = named.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
        return _answer(found, id_column)
    shared = rows.sparkSession.sparkContext.broadcast(index)
    entered = saved(_entered(nodes.select("node", "label", "size", "copies", "vec"), shared, similar), "embedding-lists")
    each = entered.select("*", F.col("entries.list").alias("lists"), F.explode("entries").alias("entry")).drop("entries")
    each = each.select("node", "label", "size", "copies", "vec", "lists", "entry.*")
    place = ["label", "size", "list"]
    counted = entered.select("label", "size", F.explode("entries.list").alias("list")).groupBy(place).agg(F.count("*").alias("n"))
    # Lists of a single vector have nothing to compare.
    several = saved(counted.where("n > 1"), "embedding-sizes")
    blocks = F.ceil(F.col("n") / F.when(F.col("n") <= 2 * block, 2 * block).otherwise(block))
    each = each.join(several, place).withColumn("blocks", blocks)
    each = each.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = each.select(
        *place, F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"),
        "block", "node", "copies", "vec", "lists", "code", "off",
    )
    found = saved(_compared(cells, shared, similar), "embedding-links")
    links = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("u is not null").select("u", "v")).select(F.col("node").alias("member"), "root")
    rooted = nodes.join(roots, F.col("node") == F.col("member"), "left").withColumn("root", F.coalesce("root", "node"))
    rooted = saved(rooted.join(links, "node", "left").select("key", "root", "copies", "least", "links"), "embedding-roots")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("copies") - 1
    classes = rooted.join(smallest, "root").select(F.col("key").alias("of"), n_links.alias("n_links"), "component")
    answered = named.select("id", "key").join(classes, F.col("key") == F.col("of"), "left")
    alone = F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("component"))
    return _answer(answered.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), alone.alias("component")), id_column)


def _answer(found: DataFrame, id_column: str) -> DataFrame:
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias(id_column), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def _fitted(nodes: DataFrame, list_size: int) -> Index | None:
    """An index of all sizes of vectors (shorter ones padded by zeros), or None without vectors."""
    n, size = nodes.agg(F.count("*"), F.max("size")).first()
    if not n:
        return None
    most = max(256, min(SAMPLE, SAMPLE_BYTES // (8 * size)))
    chosen = nodes.where(F.pmod(F.xxhash64("node"), F.lit(-(-n // most))) == 0).limit(most).select("vec").toArrow()
    vectors = [np.pad(units(np.array(v, np.float64)[None])[0], (0, size - len(v))) for v in chosen.column(0).to_pylist()]
    if not vectors:
        vectors = [np.eye(1, size)[0]]
    return fit(np.stack(vectors), -(-n // list_size))
