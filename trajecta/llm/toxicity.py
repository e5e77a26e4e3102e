"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed byte n-grams (4 to 6 bytes) inside words and at their borders, present or not in
a text. On a bounded sample of labelled documents (``PER_CLASS`` of each label, in the order of a
hash of doc_id) each feature gets its log-count ratio r; the ``FEATURES`` with the largest absolute
ratio are kept, and a logistic regression is trained on presence times r. Its intercept is moved to
the share of toxic labels among all training labels. Every text is scored whole.

Defined cases: a null text is empty; an empty text gets the intercept's score; a document with
several labels counts as toxic if any says so, a null label is no label; without labels of both
kinds the score is the smoothed share of toxic labels; repeated rows are scored each; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import bound_batches, materialise

PER_CLASS = 8000
FEATURES = 4096
BITS = 18
SIZES = (4, 5, 6)
#: Text expanded at once; n-gram arrays take about a hundred times as much.
SLICE_BYTES = 1 << 18
THRESHOLD = 0.7
_LETTER = np.where(T.ALPHANUMERIC, np.arange(256), 0x20).astype(np.uint32)
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F))


def ngrams(part: T.Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the place of each n-gram and its hashed feature; places count a blank around every text."""
    size = np.diff(part.offsets)
    padded = np.full(len(part.bytes) + part.n + 1, 0x20, np.uint32)
    padded[np.arange(len(part.bytes)) + np.repeat(np.arange(part.n), size) + 1] = _LETTER[part.lowered()]
    blanks = np.zeros(len(padded) + 1, np.int32)
    np.cumsum(padded == 0x20, out=blanks[1:])
    four = padded[:-3] | padded[1:-2] << np.uint32(8) | padded[2:-1] << np.uint32(16) | padded[3:] << np.uint32(24) if len(padded) > 3 else padded[:0]
    for n in SIZES:
        count = max(0, len(padded) - n + 1)
        h = four[:count] * _MIX[0]
        for k in range(4, n):
            h = (h ^ (h >> np.uint32(15))) * _MIX[k - 3] + padded[k : k + count] * _MIX[0]
        h = (h ^ (h >> np.uint32(16))) * _MIX[3] + np.uint32(n)
        inner = np.flatnonzero(blanks[n - 1 : n - 1 + count] == blanks[1 : 1 + count])
        yield inner, (h[inner] * _MIX[1]) >> np.uint32(32 - BITS)


def _documents(part: T.Slice, at: np.ndarray) -> np.ndarray:
    """Which document each place is in; the blank between two texts counts to the one that starts there or, last, ends there."""
    border = part.offsets + np.arange(part.n + 1)
    return np.minimum(np.searchsorted(border, at, side="right") - 1, part.n - 1)


def presence(part: T.Slice, slots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature); ``slots`` maps features to kept ones, negative for the rest."""
    docs, found = [], []
    for at, h in ngrams(part):
        f = h.astype(np.int64) if slots is None else slots[h].astype(np.int64)
        keep = np.flatnonzero(f >= 0)
        docs.append(_documents(part, at[keep]))
        found.append(f[keep])
    width = 1 << BITS
    both = np.unique(np.concatenate(docs) * width + np.concatenate(found))
    return both // width, both % width


@dataclass
class Model:
    slots: np.ndarray  # feature -> kept feature or -1
    weights: np.ndarray  # of the kept features, ratio included
    intercept: float

    def score(self, part: T.Slice) -> np.ndarray:
        doc, f = presence(part, self.slots)
        z = np.bincount(doc, weights=self.weights[f], minlength=part.n) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def logistic(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int, penalty: float = 2e-3, steps: int = 250) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on a sparse matrix, by Adam over all rows."""
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=values * w[columns], minlength=len(y)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        g = np.append(np.bincount(columns, weights=values * d[rows], minlength=width) + penalty * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, n_features: int = FEATURES) -> Model:
    """Learn from at most ``per_class`` documents of each label among those not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    share = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("k"), F.count("*").alias("n")).first()
    prior = np.log((share.k + 0.5) / (share.n - share.k + 0.5))
    order = F.xxhash64("doc_id")
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(per_class).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(per_class))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    # The sample has at most 2 * per_class rows of two numbers, so its broadcast is bounded; repeated documents count once.
    sample = materialise(own.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic"), "labelled")
    none = Model(np.full(1 << BITS, -1, np.int16), np.zeros(1), float(prior))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return none

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for part in T.slices(batches, limit=SLICE_BYTES):
            y = np.array(part.batch.column("toxic").to_pylist())
            doc, f = presence(part)
            for k in (0, 1):
                total[k] += np.bincount(f[y[doc] == k], minlength=1 << BITS)
        # One row for each 1/16 of the table.
        for i, x in enumerate(np.split(total, 16, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.astype("<i4").tobytes()], pa.binary())], ["piece", "data"])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_buffer(), "<i4") for batch in batches for x in batch.column("data"))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype("<i4").tobytes()], pa.binary())], ["piece", "data"])

    pieces = sample.mapInArrow(count, "piece int, data binary").groupBy("piece").applyInArrow(add, "piece int, data binary").collect()  # 16 rows of a fixed size
    table = np.concatenate([np.frombuffer(r.data, "<i4").reshape(2, -1) for r in sorted(pieces, key=lambda r: r.piece)], axis=1)
    no, yes = (table[0] + 0.5) / (sizes[0] + 1), (table[1] + 0.5) / (sizes[1] + 1)
    ratio = np.log(yes / (1 - yes.clip(max=1 - 1e-6))) - np.log(no / (1 - no.clip(max=1 - 1e-6)))
    seen = table.sum(axis=0) >= 3
    best = np.argsort(-np.abs(ratio) * seen, kind="stable")[:n_features]
    best = best[seen[best]]
    slots = np.full(1 << BITS, -1, np.int16)
    slots[best] = np.arange(len(best))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, limit=SLICE_BYTES):
            doc, f = presence(part, slots)
            bounds = np.searchsorted(doc, np.arange(part.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.batch.column("toxic"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(f.astype(np.int32)))], ["toxic", "features"])

    rows = sample.mapInArrow(kept, "toxic int, features array<int>").toArrow().combine_chunks()  # bounded by the sample
    flat = rows.column("features").combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy())
    columns = flat.values.to_numpy()[flat.offsets[0].as_py() : flat.offsets[-1].as_py()]
    y = rows.column("toxic").to_numpy().astype(np.float64)
    r = ratio[best]
    w, b = logistic(np.repeat(np.arange(len(y)), lengths), columns, r[columns], y, len(best))
    return Model(slots, w * r, float(b + prior - np.log(sizes[1] / sizes[0])))


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, limit=SLICE_BYTES):
            s = model.value.score(part)
            yield pa.RecordBatch.from_arrays([part.batch.column(0), part.batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns, in one pass and without a shuffle."""
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, limit=SLICE_BYTES):
            yield part.batch.filter(pa.array(model.value.score(part) < threshold))

    return docs.mapInArrow(run, docs.schema)
