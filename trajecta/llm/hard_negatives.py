"""Hard-negative mining over a vector-approximation file.

Scaled integer vectors are written once in blocks, each with its approximation: a cell number of one
byte for each dimension. The limits of cells come from a bounded sample; the outer cells of a block end
at the block's own extremes, so every bound holds for every row, whatever the sample was. A search
makes, for some anchors, a table of each dimension's least and greatest product with each cell; the
sums of the looked-up numbers are lower and upper bounds of a row's score. Only rows whose bounds
reach into what is asked for, and that the best rows of the task so far don't exclude, are scored
exactly; a cell of one integer has exact bounds.

Anchors come in passes of at most ``ANCHORS``, each sent to all tasks; every pass reads the file twice:
for the nearest of the same label, then for the windows that their scores open. A task gives the best
few of its own rows for each question, and Spark ranks those. A pass's result is written on its own.

Defined cases: rows with a null label, null vector or null, NaN or infinite component take no part;
nor does a row without vec_id, which no result could name. A row of the anchor's own vec_id is never its
positive or negative, so repeats of an anchor aren't; equal anchors (id, label and vector) are asked
once, and repeated rows each take a place. Rows of another length than the anchor's have no score with
it. Components beyond 2^26 after scaling are held there. Ties go to the smaller vec_id. Empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajecta.operators.chains import dense_numbers

from . import vectors as V
from .store import arrow_rows, fresh_path, materialise

POSITIVES, NEGATIVES = 5, 10
#: A negative's score stands between these hundredths of its positive's.
LOW, HIGH = 30, 90
CELLS = 256
#: Rows that the cells' limits are drawn from (first by hash of their id).
SAMPLE = 1024
#: Share of the sample outside the equal cells at either end.
TAIL = 0.002
#: Anchors of a pass, and their bytes.
ANCHORS, ANCHOR_BYTES = 4096, 16 << 20
#: Anchors and rows of a table of bounds.
_TILE_ANCHORS, _TILE_ROWS = 64, 1024
_NO = np.iinfo(np.int64).min // 4


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    return own.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & V.usable(F.col("embedding")))


def cell_starts(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length among the sample, the first integers of the cells after the first, by dimension."""
    seen = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    starts = {}
    for batch in seen.select(["embedding"]).combine_chunks().to_batches():
        for _, m in V.by_length(batch.column(0)):
            low, high = np.quantile(m, TAIL, axis=0), np.quantile(m, 1 - TAIL, axis=0) + 1
            starts[m.shape[1]] = np.ceil(np.linspace(low, high, CELLS + 1)[1:-1]).astype(np.int64).T
    return starts


def write_file(rows: DataFrame) -> DataFrame:
    """(dim, n, vec_id[], label[], vectors, cells, limits): blocks of rows by label, exact and approximate."""
    starts = cell_starts(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for matrix, rest in V.blocks(batches, "embedding"):
            ids, labels = (rest.column(i).to_numpy() for i in range(2))
            order = np.lexsort((ids, labels))
            matrix, n, dim = matrix[order], len(order), matrix.shape[1]
            first = starts.get(dim, np.zeros((dim, 0), np.int64))
            cells = np.stack([np.searchsorted(s, matrix[:, j], side="right") for j, s in enumerate(first)]).astype(np.uint8) if dim else np.zeros((0, n), np.uint8)
            many = first.shape[1] + 1
            limits = np.zeros((2, dim, many), np.int64)
            limits[0, :, 1:], limits[1, :, :-1] = first, first - 1
            if dim:
                # Both ends and whatever lies outside them: within the block's own extremes.
                low, high = matrix.min(axis=0)[:, None], matrix.max(axis=0)[:, None]
                limits[0, :, :1], limits[1, :, -1:] = low, high
                limits = np.clip(limits, low, high)
            ends = pa.array([0, n], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (ids, labels)]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int32()), *lists, *(pa.array([x.tobytes()], pa.binary()) for x in (matrix, cells, limits))], ["dim", "n", "vec_id", "label", "vectors", "cells", "limits"])

    kind = "dim int, n int, vec_id array<long>, label array<long>, vectors binary, cells binary, limits binary"
    return materialise(rows.mapInArrow(run, kind), "approximation-file")


class Block:
    """A block of the file."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.dim, self.n = (batch.column(i)[row].as_py() for i in range(2))
        self.ids, self.labels = (batch.column(i)[row].values.to_numpy() for i in (2, 3))
        raw = [batch.column(i)[row].as_buffer() for i in (4, 5, 6)]
        self.vectors = np.frombuffer(raw[0], np.int32).reshape(self.n, self.dim)
        self.cells = np.frombuffer(raw[1], np.uint8).reshape(self.dim, self.n)
        self.low, self.high = np.frombuffer(raw[2], np.int64).reshape(2, self.dim, -1) if self.dim else (np.zeros((0, 1), np.int64),) * 2

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(dim, cell, 2 x anchors): the least and greatest product of each anchor with each cell."""
        a, b = (x[:, :, None] * anchors.T[:, None, :] for x in (self.low, self.high))
        both = np.concatenate([np.minimum(a, b), np.maximum(a, b)], axis=2)
        most = np.abs(both).max(axis=(1, 2)).sum() if both.size else 0
        return both.astype(np.int32 if most < 1 << 31 else np.int64)

    def bounds(self, tables: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the scores of rows first..last-1 (rows) with each anchor (columns)."""
        wide = tables.shape[2]
        total, part = np.zeros((last - first, wide), tables.dtype), np.empty((last - first, wide), tables.dtype)
        for j in range(self.dim):
            np.take(tables[j], self.cells[j, first:last], axis=0, out=part, mode="clip")
            total += part
        return total[:, : wide // 2], total[:, wide // 2 :]

    def scores(self, rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """The exact score of each pair of a row and an anchor's vector."""
        return np.einsum("nd,nd->n", self.vectors[rows].astype(np.int64), anchors)


class Best:
    """The first ``k`` rows of each question, by score and then id: arrays of (question, score, id)."""

    def __init__(self, questions: int, k: int):
        self.k = k
        self.score, self.id = np.full((questions, k), _NO), np.full((questions, k), np.iinfo(np.int64).max)
        self.last = np.full(questions, _NO)

    def add(self, question: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge rows, all of them above ``last`` or equal to it."""
        if not len(question):
            return
        asked = np.unique(question)
        q = np.concatenate([np.repeat(asked, self.k), question])
        s, i = np.concatenate([self.score[asked].ravel(), score]), np.concatenate([self.id[asked].ravel(), ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        first = place < self.k
        self.score[asked], self.id[asked] = s[first].reshape(-1, self.k), i[first].reshape(-1, self.k)
        self.last[asked] = self.score[asked, -1]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, k = np.nonzero(self.score > _NO)
        return q, self.score[q, k], self.id[q, k]


class Anchors:
    """The anchors of a pass, by length and label."""

    def __init__(self, table: pa.Table):
        self.ids, self.labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        self.n = len(self.ids)
        self.sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in table.select(["embedding"]).combine_chunks().to_batches():
            for rows, matrix in V.by_length(batch.column(0)):
                order = np.argsort(self.labels[rows], kind="stable")
                self.sets[matrix.shape[1]] = (rows[order], matrix[order].astype(np.int64))

    def tiles(self, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(anchors, their vectors): those of the block's length, some at a time."""
        rows, matrix = self.sets.get(block.dim, (np.zeros(0, np.int64), None))
        for i in range(0, len(rows), _TILE_ANCHORS):
            yield rows[i : i + _TILE_ANCHORS], matrix[i : i + _TILE_ANCHORS]


def _nearest_same(anchors: Anchors, k: int) -> Callable[[Block, Best], None]:
    """For each anchor its best rows of the same label."""

    def look(block: Block, best: Best) -> None:
        rows, matrix = anchors.sets.get(block.dim, (np.zeros(0, np.int64), None))
        own = anchors.labels[rows]
        for label in np.unique(own):
            a, b = np.searchsorted(own, label), np.searchsorted(own, label, side="right")
            begin, end = np.searchsorted(block.labels, label), np.searchsorted(block.labels, label, side="right")
            for i in range(a, b if end > begin else a, _TILE_ANCHORS):
                who, vectors = rows[i : min(b, i + _TILE_ANCHORS)], matrix[i : min(b, i + _TILE_ANCHORS)]
                tables = block.tables(vectors)
                for first in range(begin, end, _TILE_ROWS):
                    last = min(end, first + _TILE_ROWS)
                    low, high = block.bounds(tables, first, last)
                    other = block.ids[first:last, None] != anchors.ids[who]
                    # k rows are at least as good as the k-th greatest lower bound.
                    least = best.last[who]
                    if last - first > k:
                        least = np.maximum(least, np.partition(np.where(other, low, _NO), -k, axis=0)[-k])
                    r, c = np.nonzero(other & (high >= least))
                    s = block.scores(first + r, vectors[c])
                    in_ = s >= least[c]
                    best.add(who[c[in_]], s[in_], block.ids[first + r[in_]])

    return look


def _windows(anchors: Anchors, low_of: np.ndarray, high_of: np.ndarray) -> Callable[[Block, Best], None]:
    """For each anchor and positive (rows of ``low_of``, ``high_of``) its best rows of another label within the window."""
    slots = low_of.shape[1]

    def look(block: Block, best: Best) -> None:
        for who, vectors in anchors.tiles(block):
            open_ = low_of[who] <= high_of[who]
            if not open_.any():
                continue
            tables = block.tables(vectors)
            for first in range(0, block.n, _TILE_ROWS):
                last = min(block.n, first + _TILE_ROWS)
                low, high = block.bounds(tables, first, last)
                other = (block.labels[first:last, None] != anchors.labels[who]) & (block.ids[first:last, None] != anchors.ids[who])
                least = np.maximum(low_of[who], best.last.reshape(-1, slots)[who])
                may = np.zeros(other.shape, bool)
                for k in range(slots):
                    may |= open_[:, k] & (high >= least[:, k]) & (low <= high_of[who, k])
                r, c = np.nonzero(may & other)
                s = block.scores(first + r, vectors[c])
                for k in range(slots):
                    in_ = (s >= least[c, k]) & (s <= high_of[who[c], k])
                    best.add(who[c[in_]] * slots + k, s[in_], block.ids[first + r[in_]])

    return look


def _search(file: DataFrame, look: Callable[[Block, Best], None], questions: int, k: int) -> DataFrame:
    """(question, score, id, rank): the first ``k`` rows of each question over the whole file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(questions, k)
        for batch in batches:
            for row in range(batch.num_rows):
                look(Block(batch, row), best)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.found()], ["question", "score", "id"])

    own = file.mapInArrow(run, "question long, score long, id long")
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "id"))
    return own.withColumn("rank", place).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, per_pass: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors(vec_id, embedding, label)``.

    For each row of ``is_anchor`` (a condition on vec_id, label and embedding) and each of its best
    ``positives`` rows of the same label, the best ``negatives`` rows of other labels whose score is
    at least ``low`` and at most ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    rows = usable_rows(vectors)
    with arrow_rows(spark, V.VECTORS_AT_ONCE):
        file = write_file(rows)
        asked = rows.where(is_anchor).distinct()
        longest = asked.agg(F.max(F.size("embedding"))).first()[0] or 1
    per_pass = max(1, min(per_pass, ANCHOR_BYTES // (8 * longest)))
    numbered = materialise(dense_numbers(asked, ["vec_id", "label", "embedding"]).withColumn("pass", F.floor(F.col("number") / per_pass)), "anchors")
    last = numbered.agg(F.max("pass")).first()[0]
    root = fresh_path(spark, "hard-negatives")
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with arrow_rows(spark, V.BLOCKS_AT_ONCE):
        for i in range(-1 if last is None else int(last) + 1):
            own = Anchors(numbered.where(F.col("pass") == i).orderBy("number").toArrow())  # at most per_pass of them
            near = _search(file, _nearest_same(own, positives), own.n, positives).toArrow()
            _ranked(file, own, near, positives, negatives, low, high).write.parquet(f"{root}/pass={i}")
    if last is None:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(*[f"{root}/pass={i}" for i in range(int(last) + 1)])


def _ranked(file: DataFrame, own: Anchors, near: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The windows of one pass, answered."""
    q, place = near.column("question").to_numpy(), near.column("rank").to_numpy() - 1
    score, ids = near.column("score").to_numpy(), near.column("id").to_numpy()
    low_of, high_of = np.ones((own.n, positives), np.int64), np.zeros((own.n, positives), np.int64)
    low_of[q, place], high_of[q, place] = -(-low * score // 100), high * score // 100
    windows = pa.table({"question": q * positives + place, "anchor_id": own.ids[q], "positive_id": ids, "positive_score": score})
    answers = _search(file, _windows(own, low_of, high_of), own.n * positives, negatives)
    spark: SparkSession = file.sparkSession
    named = answers.join(F.broadcast(spark.createDataFrame(windows)), "question")  # at most positives x per_pass rows
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = f"""
WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, k.vec_id AS b, a.label = k.label AS same, CAST(list_inner_product(a.v, k.v) AS BIGINT) AS score FROM k a JOIN k ON k.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= {POSITIVES})
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}
"""
