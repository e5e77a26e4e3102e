"""Vector code compression: product codes whose codebooks are trained by filtering Lloyd rounds.

Scaled integer vectors are cut into parts. Every task builds, for each part position of its blocks, a
kd-tree over the parts of the block; the blocks are written once, in tree order, and read by every
round. A round walks each tree with the codebook's entries: cached boxes, sums and counts of a node
let entries that are nearer to no point of its box go, and a node with one entry left is assigned
whole. What a task finds leaves it as one sum and count for each entry; Spark adds them up, and only
the entries (parts x entries of them, whatever the input's size) come to the driver.

All arithmetic is on integers, so results depend neither on trees nor on partitions.

Defined cases: a row whose vector is null or has a null, NaN or infinite component is dropped; so is a
vector of another length than most have (ties: the shortest of these lengths). A vector whose length
is no multiple of the parts is filled up with zeros. The first codebook takes rows in order of
(vec_id, vector), null ids last; with fewer rows than entries it is as short as they are. Repeated
rows are rows of their own. Components beyond 2^26 after scaling are held there. Empty tables give
empty results; extra columns are ignored. Equal labels, nulls too, share one ``label_error``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import vectors as V
from .store import arrow_rows, materialise

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Points of a leaf: at least these, fewer than twice as many.
LEAF = 16


def grow(points: np.ndarray, depth: int) -> np.ndarray:
    """The points' order in a kd-tree of 2^depth leaves of one size: each node is cut at the median of its widest side."""
    order = np.arange(len(points))
    for level in range(depth):
        nodes = order.reshape(1 << level, -1)
        own = points[nodes]
        side = (own.max(axis=1) - own.min(axis=1)).argmax(axis=1)
        key = np.take_along_axis(own, side[:, None, None], axis=2)[:, :, 0]
        order = np.take_along_axis(nodes, np.argpartition(key, nodes.shape[1] // 2 - 1, axis=1), axis=1)
    return order.ravel()


class Tree:
    """A part's points in tree order, with each node's box, count and sum (level by level, from the leaves up)."""

    def __init__(self, points: np.ndarray, real: np.ndarray, depth: int):
        self.points, self.real, self.depth = points, real, depth
        own = points.reshape(1 << depth, -1, points.shape[1])
        weight = real.reshape(1 << depth, -1)
        self.low, self.high = [own.min(axis=1)], [own.max(axis=1)]
        self.count, self.sum = [weight.sum(axis=1)], [(own * weight[:, :, None]).sum(axis=1)]
        for _ in range(depth):
            for values, join in ((self.low, np.minimum), (self.high, np.maximum), (self.count, np.add), (self.sum, np.add)):
                values.insert(0, join(values[0][0::2], values[0][1::2]))

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(each point's entry in tree order, each entry's count, each entry's sum).

        Nearest by squared distance, ties to the lower entry. Pairs of a node and an entry that may
        still be nearest somewhere in its box go down the tree together.
        """
        owner = np.zeros(len(self.points), np.int64)
        count, total = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        length = (book * book).sum(axis=1)
        node, entry = np.zeros(len(book), np.int64), np.arange(len(book))
        for level in range(self.depth + 1):
            if not len(node):
                break
            low, high = self.low[level][node], self.high[level][node]
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            many = np.diff(np.append(first, len(node)))
            best = np.repeat(_nearest(((2 * book[entry] - low - high) ** 2).sum(axis=1), entry, first, many), many)
            away = book[entry] - book[best]
            # The least of |e - p|^2 - |best - p|^2 over the box, at the corner farthest towards e.
            gap = length[entry] - length[best] - 2 * (np.where(away > 0, high, low) * away).sum(axis=1)
            keep = (gap < 0) | ((gap == 0) & (entry <= best))
            left = np.add.reduceat(keep.astype(np.int64), first)
            whole = left == 1
            done, by = node[first][whole], best[first][whole]
            np.add.at(count, by, self.count[level][done])
            np.add.at(total, by, self.sum[level][done])
            size = len(self.points) >> level
            owner.reshape(-1, size)[done] = by[:, None]
            keep &= np.repeat(~whole, many)
            node, entry = node[keep], entry[keep]
            if level < self.depth:
                both = np.concatenate([2 * node, 2 * node + 1])
                order = np.argsort(both, kind="stable")
                node, entry = both[order], np.concatenate([entry, entry])[order]
        if len(node):
            self._leaves(book, length, node, entry, owner, count, total)
        return owner, count, total

    def _leaves(self, book, length, node, entry, owner, count, total) -> None:
        """Single points of the leaves that several entries share."""
        leaf = len(self.points) >> self.depth
        own = self.points.reshape(-1, leaf, self.points.shape[1])
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        many = np.diff(np.append(first, len(node)))
        at = node[first]
        far = length[entry][:, None] - 2 * np.einsum("nlw,nw->nl", own[node], book[entry])
        by = _nearest(far, entry, first, many)
        owner.reshape(-1, leaf)[at] = by
        real = self.real.reshape(-1, leaf)[at]
        np.add.at(count, by.ravel(), real.ravel())
        np.add.at(total, by.ravel(), (own[at] * real[:, :, None]).reshape(-1, own.shape[2]))


def _nearest(far: np.ndarray, entry: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The entry of each node's least distance, the lowest of equal ones; columns of ``far`` are points."""
    least = np.repeat(np.minimum.reduceat(far, first, axis=0), many, axis=0)
    names = entry if far.ndim == 1 else entry[:, None]
    return np.minimum.reduceat(np.where(far == least, names, np.iinfo(np.int64).max), first, axis=0)


def _width(dim: int, parts: int) -> int:
    return max(1, -(-dim // parts))


def _depth(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def write_blocks(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(dim, n, vec_id[], label[], points, places): blocks of usable vectors, each part in the order of its tree.

    ``places`` names the row that each point came from; numbers from n on fill the tree up.
    """
    own = vectors.where(V.usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    kind = S.StructType([S.StructField("dim", S.IntegerType()), S.StructField("n", S.IntegerType()), S.StructField("vec_id", S.ArrayType(S.LongType())), S.StructField("label", S.ArrayType(own.schema["label"].dataType)), S.StructField("points", S.BinaryType()), S.StructField("places", S.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for matrix, rest in V.blocks(batches, "embedding"):
            n, dim = matrix.shape
            depth, width = _depth(n), _width(dim, parts)
            size = -(-n >> depth) << depth
            full = np.zeros((size, parts * width), np.int32)
            full[:n, :dim] = matrix
            full[n:] = full[0]
            points, places = [], []
            for p in range(parts):
                part = full[:, p * width : (p + 1) * width]
                order = grow(part, depth)
                points.append(part[order].tobytes())
                places.append(order.astype(np.int32).tobytes())
            ends = pa.array([0, n], pa.int32())
            columns = [pa.ListArray.from_arrays(ends, rest.column(i)) for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int32()), *columns, pa.array([b"".join(points)], pa.binary()), pa.array([b"".join(places)], pa.binary())], ["dim", "n", "vec_id", "label", "points", "places"])

    return materialise(own.mapInArrow(run, kind), "vector-blocks")


def _trees(batch: pa.RecordBatch, row: int, parts: int) -> Iterator[tuple[int, Tree, np.ndarray]]:
    """(part, tree, places) of a block."""
    dim, n = (batch.column(i)[row].as_py() for i in range(2))
    depth, width = _depth(n), _width(dim, parts)
    places = np.frombuffer(batch.column("places")[row].as_buffer(), np.int32).reshape(parts, -1)
    points = np.frombuffer(batch.column("points")[row].as_buffer(), np.int32).reshape(parts, -1, width)
    for p in range(parts):
        yield p, Tree(points[p].astype(np.int64), (places[p] < n).astype(np.int64), depth), places[p]


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one assignment and replacement."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for p, tree, _ in _trees(batch, row, parts):
                    _, n, s = tree.assign(books[p])
                    count[p] += n
                    total[p] += s
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (p, e, count[p, e], *total[p, e].T)], names)

    names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]
    sums = blocks.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names[2:]])
    new = books.copy()
    for r in sums.toLocalIterator():  # at most parts x entries rows
        new[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return new


def _first_books(vectors: DataFrame, dim: int, parts: int, entries: int) -> np.ndarray:
    own = vectors.where(V.usable(F.col("embedding")) & (F.size("embedding") == dim))
    rows = own.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    width = _width(dim, parts)
    full = np.zeros((len(rows), parts * width), np.int64)
    full[:, :dim] = V.scaled(np.array([r.embedding for r in rows], np.float64).reshape(len(rows), dim))
    return np.ascontiguousarray(full.reshape(len(rows), parts, width).transpose(1, 0, 2))


def _codes(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    parts = len(books)
    kind = S.StructType([S.StructField("vec_id", S.LongType()), S.StructField("label", blocks.schema["label"].dataType.elementType), S.StructField("code", S.StringType()), S.StructField("error", S.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column("n")[row].as_py()
                code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, tree, places in _trees(batch, row, parts):
                    owner, _, _ = tree.assign(books[p])
                    far = ((tree.points - books[p][owner]) ** 2).sum(axis=1)
                    real = places < n
                    code[places[real], p] = owner[real]
                    error[places[real]] += far[real]
                text, step = code.tobytes().hex(), 2 * parts
                hexed = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * step).tobytes()), pa.py_buffer(text.encode())])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[row].values, batch.column("label")[row].values, hexed, pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, kind)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks[part, entry, component]) of ``vectors(vec_id, embedding, label)``.

    A code is the entry's number of each part, two hex digits each; ``entries`` is 256 at most.
    """
    if not 0 < entries <= 256:
        raise ValueError(f"a code has 1 to 256 entries, not {entries}")
    spark = vectors.sparkSession
    with arrow_rows(spark, V.VECTORS_AT_ONCE):
        blocks = write_blocks(vectors, parts)
    most = blocks.groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not most:
        return _codes(blocks, np.zeros((parts, 0, 1), np.int64)), np.zeros((parts, 0, 1), np.int64)
    own = blocks.where(F.col("dim") == most[0].dim)
    books = _first_books(vectors, most[0].dim, parts, entries)
    with arrow_rows(spark, V.BLOCKS_AT_ONCE):
        for _ in range(rounds):
            books = _round(own, books)
        return materialise(_codes(own, books), "vector-codes"), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256)."""
    codes, books = compress(vectors)
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    found = codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return found.withColumn("codebooks_sha256", F.lit(books_digest(books)))


def _sql() -> str:
    """The query in SQL: distances less the part's own square, as inner products."""
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, label, part, list_slice(v, part * (len(v) // {PARTS}) + 1, (part + 1) * (len(v) // {PARTS})) AS v FROM k, range({PARTS}) r(part))",
        f"b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS (SELECT vec_id, label, p.part, p.v, min({{'d': list_inner_product(b.v, b.v) - 2 * list_inner_product(b.v, p.v), 'e': entry}}) AS m FROM p JOIN b{i} b ON b.part = p.part GROUP BY vec_id, label, p.part, p.v)")
        if i < ROUNDS:
            steps.append(f"n{i} AS (SELECT part, entry, list(floor(s / n) ORDER BY i) AS v FROM (SELECT part, m.e AS entry, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) r(i) WHERE i <= len(v) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"b{i + 1} AS (SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM b{i} b LEFT JOIN n{i} n ON n.part = b.part AND n.entry = b.entry)")
    last = f"a{ROUNDS}"
    steps.append(f"o AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d + list_inner_product(v, v)) AS BIGINT) AS error FROM {last} GROUP BY vec_id, label)")
    steps.append(f"h AS (SELECT sha256(string_agg(CAST(v[i] AS BIGINT), ',' ORDER BY part, entry, i)) AS s FROM b{ROUNDS}, range(1, 65) r(i) WHERE i <= len(v))")
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.s AS codebooks_sha256 FROM o, h"


SQL = _sql()
