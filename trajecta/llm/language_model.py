"""Language-model scoring with a hashed maximum-entropy model.

p(word | history) = p(class | history) * p(word | class, history). Both factors are softmaxes over
hashed features of the history: the last word, the last two, and two that skip a word. The ``SINGLE``
most frequent words are classes of their own, the next ``HEAD * MEMBERS`` fill classes of ``MEMBERS``
words by rank; all others fall into ``CLASSES - SINGLE - HEAD`` classes of ``MEMBERS`` buckets by hash.
The words of a bucket have one feature, their training count (with half a count for each and for one
unseen word), so probabilities add up to one.

Training is two distributed gradient updates over all training documents, each used once. A gradient
is observed less expected counts of every (feature, output); each task sums them over its documents
and the sums meet in a tree. An update moves a weight by ``RATE * log((observed + d) / (expected +
d))``, the gradient's direction at the scale of its counts. The first update takes the documents
outside the ``1 / SECOND`` that a hash of doc_id sets apart, with the expectation of the priors; the
second takes those, with the expectation of the model so far, which has not seen them. The sums don't
depend on how the input is split (the second's only up to rounding). The feature tables have a row
for each ``TOKENS_A_ROW`` training tokens, between ``ROWS[0]`` and ``ROWS[1]``.

Counts cover all training tokens. Documents are grouped into chunks of about ``CHUNK_BYTES``; each
chunk asks once for each distinct word outside the head and gets its count from a join on the word,
so the vocabulary is never sent whole to anyone; the head, of a fixed size, is broadcast.

Words are keyed by 64-bit hashes. Defined cases: a null text is empty and scores its end alone; a
null doc_id counts as training; with no training tokens every base probability is 1; repeated rows
count and are scored each (equal rows of one doc_id share a chunk); equal counts rank by the word's
hash; a very long text is one document of its chunk; empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import materialise

CLASSES = 64
MEMBERS = 64
SINGLE = 16
HEAD = 16
ROWS = (1 << 12, 1 << 16)
TOKENS_A_ROW = 128
CHUNK_BYTES = 8 << 20
TASK_BYTES = 32 << 20
TASKS = 8192
SECOND = 16
RATE = 0.6
SMOOTHING = (2.0, 8.0)  # of the first and the second update
LIMIT = 10.0  # of a weight
STEP = 1 << 12
_BLOCK = 1024
_TOGETHER = 64  # tasks whose tables meet at once
END = np.uint64(0x51ED270B2F6A1D3C)
_BEFORE = np.uint64(0x2545F4914F6CDD1D)
_SALT = tuple(np.uint64(x) for x in (0x9FB21C651E98DF25, 0xA24BAED4963EE407, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_TAIL = SINGLE + HEAD
assert CLASSES - _TAIL == 32 and MEMBERS == 64  # the shifts and masks of tail words


def tokens(part: T.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's tokens, an end after each document, and the documents' offsets."""
    buf = part.lowered()
    w = T.Words(buf, part.offsets, T.NOT_SPACE)
    h = np.full(len(w.start) + part.n, END, np.uint64)
    h[np.arange(len(w.start)) + w.doc] = T.Prefix(buf).hashes(w.start, w.end)
    return h, w.offsets + np.arange(part.n + 1)


def features(h: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Four hashed features of each token's history: last word, last two, and two with a skip."""
    place = np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))
    back = []
    for k in (1, 2, 3):
        p = np.full(len(h), _BEFORE, np.uint64)
        p[k:] = h[:-k] if len(h) > k else h[:0]
        p[place < k] = _BEFORE
        back.append(p)
    one, two, three = back
    return [T.mix(one ^ _SALT[0]), T.mix(T.mix(one ^ _SALT[1]) + two), T.mix(two ^ _SALT[2]), T.mix(T.mix(one ^ _SALT[3]) + three)]


@dataclass
class Classes:
    """The output tree: the head's words, and the training tokens and distinct words of each leaf."""

    words: np.ndarray  # the head's hashes, sorted
    leaf: np.ndarray  # of each head word
    count: np.ndarray  # of each head word
    n: np.ndarray  # [CLASSES, MEMBERS] tokens
    v: np.ndarray  # [CLASSES, MEMBERS] distinct words; buckets only
    rows: int

    @staticmethod
    def place(rank: np.ndarray) -> np.ndarray:
        """The leaf of the head word of each rank."""
        return np.where(rank < SINGLE, rank * MEMBERS, SINGLE * MEMBERS + rank - SINGLE)

    def of(self, h: np.ndarray) -> np.ndarray:
        """The leaf of each word."""
        out = ((_TAIL + ((h >> np.uint64(8)) & np.uint64(31))) * np.uint64(MEMBERS) + ((h >> np.uint64(20)) & np.uint64(63))).astype(np.int32)
        if len(self.words):
            at = np.searchsorted(self.words, h).clip(max=len(self.words) - 1)
            own = self.words[at] == h
            out[own] = self.leaf[at[own]]
        return out

    def priors(self) -> tuple[np.ndarray, np.ndarray]:
        """Log-priors of the classes, and of the members inside each (as good as none for members without words)."""
        there = np.zeros((CLASSES, MEMBERS))
        there.ravel()[self.leaf] = 1
        there[_TAIL:] = 1
        n = self.n + 0.5 * there
        inner = np.log(np.maximum(n, 1e-12)) - np.log(np.maximum(n.sum(axis=1, keepdims=True), 1e-9))
        total = n.sum(axis=1) + 1e-9
        return np.log(total / total.sum()).astype(np.float32), inner.astype(np.float32)

    def bucket_log10(self) -> np.ndarray:
        """Log10 of each leaf's count with half counts; zero where a leaf is one word."""
        out = np.log10(self.n + 0.5 * (self.v + 1))
        out[:_TAIL] = 0
        return out.ravel()

    def rows_of(self, keys: list[np.ndarray], leaf: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows of the class table and of the member table (whose low bits are the class) for each feature."""
        bits = self.rows.bit_length() - 1
        own = leaf // MEMBERS
        first = [(k >> np.uint64(64 - bits)).astype(np.int32) for k in keys]
        return first, [(x & np.int32(self.rows - CLASSES)) | own for x in ((k >> np.uint64(20)).astype(np.int32) for k in keys)]


class Scorer:
    """Sums of weights for a few thousand tokens at a time, in buffers that stay in the cache."""

    def __init__(self, known: Classes, weights: tuple[np.ndarray, np.ndarray]):
        self.prior, self.inner = known.priors()
        self.weights = weights
        self.z, self.y, self._one = (np.empty((STEP, CLASSES), np.float32) for _ in range(3))

    def run(self, first: list[np.ndarray], second: list[np.ndarray], leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the classes and of the members of each token's class."""
        n, own = len(leaf), leaf // MEMBERS
        z, y, one = self.z[:n], self.y[:n], self._one[:n]
        for out, table, rows in ((z, self.weights[0], first), (y, self.weights[1], second)):
            np.take(table, rows[0], axis=0, out=out, mode="clip")
            for r in rows[1:]:
                out += np.take(table, r, axis=0, out=one, mode="clip")
        z += self.prior
        y += np.take(self.inner, own, axis=0, out=one, mode="clip")
        return z, y

    def log_probabilities(self, first: list[np.ndarray], second: list[np.ndarray], leaf: np.ndarray) -> np.ndarray:
        """Of each token's leaf."""
        out = np.empty(len(leaf))
        for at in range(0, len(leaf), STEP):
            s = slice(at, at + STEP)
            k = leaf[s]
            z, y = self.run([r[s] for r in first], [r[s] for r in second], k)
            i = np.arange(len(k))
            got = z[i, k // MEMBERS] + y[i, k % MEMBERS]
            out[s] = got - np.log(np.exp(z, out=z).sum(axis=1)) - np.log(np.exp(y, out=y).sum(axis=1))
        return out


def _add_rows(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total[ordered[first]] += np.add.reduceat(values[order], first, axis=0)


def _updated(docs: DataFrame, known: Classes, weights: tuple[np.ndarray, np.ndarray], size: int, own: Callable[[T.Slice, list[np.ndarray]], None], expects: bool) -> tuple[np.ndarray, np.ndarray]:
    """The weights after one update. ``own`` adds a slice's observed (and expected) counts to a task's tables.

    The tasks' tables meet block by block in a tree, and the tree's last step moves the block's weights,
    so only weights come to the driver.
    """
    rows, smoothing = known.rows, SMOOTHING[int(expects)]
    old = docs.sparkSession.sparkContext.broadcast(weights)
    priors = known.priors()

    def packed(block: int, seen: np.ndarray, expected: np.ndarray | None) -> tuple:
        return block, zlib.compress(seen.astype("<i8").tobytes(), 1), None if expected is None else zlib.compress(expected.astype("<f4").tobytes(), 1)

    def unpacked(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray | None]:
        seen = sum(np.frombuffer(zlib.decompress(x.as_buffer()), "<i8") for x in table.column("seen")).reshape(_BLOCK, CLASSES)
        expected = sum(np.frombuffer(zlib.decompress(x.as_buffer()), "<f4").astype(np.float64) for x in table.column("expected")).reshape(_BLOCK, CLASSES) if expects else None
        return table.column("block")[0].as_py(), seen, expected

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((rows, CLASSES), np.int32 if k < 2 else np.float32) for k in range(4 if expects else 2)]
        for part in T.slices(batches):
            own(part, total)
        for k in (0, 1):
            for b in range(0, rows, _BLOCK):
                seen = total[k][b : b + _BLOCK]
                if seen.any():
                    row = packed(k * (rows // _BLOCK) + b // _BLOCK, seen, total[k + 2][b : b + _BLOCK] if expects else None)
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names)

    def add(table: pa.Table) -> pa.Table:
        return pa.table([pa.array([x], t) for x, t in zip(packed(*unpacked(table)), kinds, strict=True)], names)

    def move(table: pa.Table) -> pa.Table:
        block, seen, expected = unpacked(table)
        k, b = divmod(block, rows // _BLOCK)
        if expected is None:
            expected = seen.sum(axis=1, keepdims=True) * np.exp(priors[k] if k == 0 else priors[k][np.arange(_BLOCK) % CLASSES])
        w = old.value[k][b * _BLOCK : (b + 1) * _BLOCK] + RATE * np.log((seen + smoothing) / (expected + smoothing))
        return pa.table({"block": table.column("block")[:1], "data": pa.array([np.clip(w, -LIMIT, LIMIT).astype("<f4").tobytes()], pa.binary())})

    names, kinds, schema = ["block", "seen", "expected"], [pa.int32(), pa.binary(), pa.binary()], "block int, seen binary, expected binary"
    tasks = max(1, min(TASKS, -(-size // TASK_BYTES)))
    partial = docs.select("text").coalesce(tasks).mapInArrow(run, schema)
    if tasks > _TOGETHER:
        partial = partial.withColumn("branch", F.spark_partition_id() % -(-tasks // _TOGETHER)).groupBy("block", "branch").applyInArrow(add, schema)
    out = tuple(w.copy() for w in weights)
    for r in partial.groupBy("block").applyInArrow(move, "block int, data binary").toLocalIterator():  # as many rows as blocks
        k, b = divmod(r.block, rows // _BLOCK)
        out[k][b * _BLOCK : (b + 1) * _BLOCK] = np.frombuffer(r.data, "<f4").reshape(_BLOCK, CLASSES)
    return out


def _observed(known: Classes, leaf: np.ndarray, first: list[np.ndarray], second: list[np.ndarray], total: list[np.ndarray]) -> None:
    for table, rows, output in ((total[0], first, leaf // MEMBERS), (total[1], second, leaf % MEMBERS)):
        table += np.bincount(np.concatenate([r * CLASSES + output for r in rows]), minlength=table.size).reshape(table.shape)


def train(docs: DataFrame, known: Classes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The class and member weights after both updates. ``docs`` (text, apart): the training documents."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(known)

    def count(part: T.Slice, total: list[np.ndarray]) -> None:
        h, offsets = tokens(part)
        leaf = model.value.of(h)
        _observed(model.value, leaf, *model.value.rows_of(features(h, offsets), leaf), total)

    nothing = tuple(np.zeros((known.rows, CLASSES), np.float32) for _ in range(2))
    weights = _updated(docs.where(~F.col("apart")), known, nothing, size, count, expects=False)
    sent = spark.sparkContext.broadcast(weights)

    def expect(part: T.Slice, total: list[np.ndarray]) -> None:
        own = model.value
        scorer = Scorer(own, sent.value)
        h, offsets = tokens(part)
        leaf = own.of(h)
        first, second = own.rows_of(features(h, offsets), leaf)
        _observed(own, leaf, first, second, total[:2])
        for at in range(0, len(h), STEP):
            s = slice(at, at + STEP)
            a, b = [r[s] for r in first], [r[s] for r in second]
            for table, rows, values in zip(total[2:], (a, b), scorer.run(a, b, leaf[s]), strict=True):
                p = np.exp(values, out=values)
                p /= p.sum(axis=1, keepdims=True)
                for r in rows:
                    _add_rows(table, r, p)

    return _updated(docs.where("apart"), known, weights, size // 4, expect, expects=True)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def _vocabulary(chunked: DataFrame) -> DataFrame:
    """(chunk, word, n): each chunk's distinct words and how often its training documents have them."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for part in T.slices(batches):
            h, offsets = tokens(part)
            train = ~np.array(part.batch.column("held_out").to_pylist(), bool)
            own, back = np.unique(h, return_inverse=True)
            n = np.bincount(back, weights=np.repeat(train, np.diff(offsets)).astype(np.float64), minlength=len(own)).astype(np.int64)
            both, back = np.unique(np.concatenate([words, own]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            total[back[: len(words)]] = counts
            total[back[len(words) :]] += n
            words, counts = both, total
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), key[0].as_py(), np.int32)), _signed(words), pa.array(counts)], ["chunk", "word", "n"])

    return chunked.groupBy("chunk").applyInArrow(run, "chunk int, word long, n long")


def output_tree(counts: DataFrame, n_tokens: int) -> Classes:
    """The head and the leaves' counts from (word, c); what comes to the driver has a fixed size."""
    top = counts.where("c > 0").orderBy(F.desc("c"), "word").limit(SINGLE + HEAD * MEMBERS).collect()
    words, count = np.array([r.word for r in top], np.int64).view(np.uint64), np.array([r.c for r in top], np.int64)
    leaf = Classes.place(np.arange(len(top))).astype(np.int32)
    n, v = np.zeros(CLASSES * MEMBERS), np.zeros(CLASSES * MEMBERS)
    n[leaf] = count
    bucket = (F.shiftrightunsigned("word", 8).bitwiseAND(31) * MEMBERS + F.shiftrightunsigned("word", 20).bitwiseAND(63) + _TAIL * MEMBERS).cast("int")
    for r in _outside(counts, words).where("c > 0").groupBy(bucket.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        n[r.k], v[r.k] = r.n, r.v
    order = np.argsort(words)
    rows = max(ROWS[0], min(ROWS[1], 1 << max(0, int(n_tokens // TOKENS_A_ROW)).bit_length()))
    return Classes(words[order], leaf[order], count[order], n.reshape(CLASSES, MEMBERS), v.reshape(CLASSES, MEMBERS), rows)


def _outside(words: DataFrame, head: np.ndarray) -> DataFrame:
    return words.where(~F.col("word").isin([int(x) for x in head.view(np.int64)])) if len(head) else words


def _hash_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string"))


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document its tokens, the base score and the model's score (log10), learnt from all rows that aren't held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    no = F.lit(False)
    own = own.withColumn("held_out", F.coalesce(_hash_of(F.col("doc_id")) % 5 == 1, no)).withColumn("apart", F.coalesce(F.shiftright(_hash_of(F.col("doc_id")), 8) % SECOND == 0, no))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0)).alias("n")).first().n
    n_chunks = max(1, -(-size // chunk_bytes))
    chunked = own.drop("apart").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int"))

    asked = materialise(_vocabulary(chunked), "vocabulary")
    counts = materialise(asked.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    known = output_tree(counts, total.n)
    model = docs.sparkSession.sparkContext.broadcast((known, train(own.where(~F.col("held_out")), known, size)))
    found = _outside(asked.select("chunk", "word"), known.words).join(counts, "word")
    base_log, n_train = np.log10(total.n + 0.5 * (total.v + 1)), total.n

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, weights = model.value
        scorer, inner = Scorer(known, weights), known.bucket_log10()
        words = np.concatenate([right.column("word").to_numpy().view(np.uint64), known.words])
        order = np.argsort(words)
        words, c = words[order], np.concatenate([right.column("c").to_numpy(), known.count])[order]
        leaf_of, half_of = known.of(words), np.log10(c + 0.5)
        in_bucket = np.where(leaf_of >= _TAIL * MEMBERS, half_of - inner[leaf_of], 0.0)
        out = []
        for part in T.slices(left.to_batches()):
            h, offsets = tokens(part)
            at = np.searchsorted(words, h)
            if not (words[at.clip(max=len(words) - 1)] == h).all():
                raise RuntimeError("a chunk's words and counts do not match")
            leaf = leaf_of[at]
            p = scorer.log_probabilities(*known.rows_of(features(h, offsets), leaf), leaf) / np.log(10) + in_bucket[at]
            size = np.diff(offsets)
            arrays = [part.batch.column("doc_id"), part.batch.column("held_out"), pa.array(size), pa.array(T.per_doc_sum(c[at] > 0, offsets)), pa.array(np.full(part.n, n_train, np.int64))]
            out.append(pa.RecordBatch.from_arrays([*arrays, pa.array(T.per_doc_sum(half_of[at], offsets) - size * base_log), pa.array(T.per_doc_sum(p, offsets))], names))
        return pa.Table.from_batches(out, schema)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)))
    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
