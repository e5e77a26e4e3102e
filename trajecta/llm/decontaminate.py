"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of documents. Its words become symbols of the benchmark's vocabulary; only runs
of such words that are long enough for the shortest test phrase are indexed, since no other place
can hold one. The index is a suffix array kept at sampled positions, a Burrows-Wheeler transform in
a wavelet matrix, and symbol counts. All test phrases are searched backwards at once, occurrences
are located over the sampled positions, and their word spans are merged.

The phrases are sent to the executors in blocks of at most ``BLOCK_BYTES`` of benchmark text, so a
broadcast stays bounded; a larger benchmark is searched block by block and the spans are merged.

Defined cases: null and empty texts have no words and are not contaminated; a benchmark item without
words has no window; items with equal texts are all named; a null item_id marks words but is not
named; repeated document rows each get a row; empty tables give empty or clean results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import materialise

WINDOW = 13
BLOCK_BYTES = 16 << 20
SAMPLE = 8


class WaveletMatrix:
    """Ranks of symbols in a sequence."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            z = np.zeros(len(seq) + 1, np.int64)
            np.cumsum(bit == 0, out=z[1:])
            self.zeros.append(z)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.begin = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, z in zip(range(self.levels - 1, -1, -1), self.zeros, strict=True):
            zero = z[at]
            at = np.where((symbol >> level) & 1, z[-1] + at - zero, zero)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        return self._descend(symbol, at) - self.begin[symbol]


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol must be the only smallest one."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    n, k = len(seq), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        np.cumsum(key[order[1:]] != key[order[:-1]], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Backward search over a sequence of symbols; symbol 0 is kept for the end."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = SAMPLE):
        seq = np.append(seq, 0)
        sa = suffix_array(seq)
        self.bwt = seq[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.ranks = WaveletMatrix(self.bwt, sigma)
        self.sampled = sa % sample == 0
        self.place = np.cumsum(self.sampled) - 1
        self.positions = sa[self.sampled]
        self.n = len(seq)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (phrase, from, to) of the phrases (one per row, equally long) that occur."""
        which = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[which, k]
            lo = self.first[symbol] + self.ranks.rank(symbol, lo)
            hi = self.first[symbol] + self.ranks.rank(symbol, hi)
            left = hi > lo
            which, lo, hi = which[left], lo[left], hi[left]
            if not len(which):
                break
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffix-array rows, walking to the nearest sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, todo = rows.copy(), np.arange(len(rows))
        while len(todo):
            done = self.sampled[at]
            out[todo[done]] = self.positions[self.place[at[done]]] + steps[todo[done]]
            todo, at = todo[~done], at[~done]
            symbol = self.bwt[at]
            at = self.first[symbol] + self.ranks.rank(symbol, at)
            steps[todo] += 1
        return out


class Phrases:
    """The windows of some benchmark items, by length, with the items that each belongs to."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        part = T.Slice(pa.RecordBatch.from_arrays([pa.array([t for _, t in items], pa.string())], ["text"]))
        buf = part.lowered()
        w = T.Words(buf, part.offsets, T.ALPHANUMERIC)
        hashes = T.Prefix(buf).hashes(w.start, w.end)
        self.vocabulary = np.unique(hashes)
        self.sigma = len(self.vocabulary) + 2
        symbol = np.searchsorted(self.vocabulary, hashes) + 2
        self.ids = [i for i, _ in items]
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item in range(len(items)):
            own = symbol[w.offsets[item] : w.offsets[item + 1]].tolist()
            if own:
                n = min(window, len(own))
                at = found.setdefault(n, {})
                for i in range(len(own) - n + 1):
                    at.setdefault(tuple(own[i : i + n]), set()).add(item)
        self.windows = {n: (np.array(list(x), np.int64), [np.array(sorted(v)) for v in x.values()]) for n, x in found.items()}
        self.shortest = min(found, default=0)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The benchmark's symbol of each word, 1 for other words."""
        out = np.ones(len(hashes), np.int64)
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, hashes[maybe]).clip(max=len(self.vocabulary) - 1)
        good = self.vocabulary[at] == hashes[maybe]
        out[maybe[good]] = at[good] + 2
        return out


def find_spans(part: T.Slice, phrases: Phrases) -> tuple[T.Words, np.ndarray, list[np.ndarray]]:
    """The words of a shard, which of them a phrase covers, and per document the items found."""
    buf = part.lowered()
    w = T.Words(buf, part.offsets, T.ALPHANUMERIC)
    cover = np.zeros(len(w.start) + 1, np.int64)
    items: list[np.ndarray] = [np.zeros(0, np.int64)] * part.n
    if not phrases.windows or not len(w.start):
        return w, np.zeros(len(w.start), bool), items
    symbol = phrases.symbols(T.Prefix(buf).hashes(w.start, w.end))
    known = symbol > 1
    # Runs of known words within a document.
    begins = known.copy()
    begins[1:] &= ~(known[:-1] & (w.doc[1:] == w.doc[:-1]))
    start = np.flatnonzero(begins)
    ends = known.copy()
    ends[:-1] &= ~(known[1:] & (w.doc[1:] == w.doc[:-1]))
    length = np.flatnonzero(ends) + 1 - start
    start, length = start[length >= phrases.shortest], length[length >= phrases.shortest]
    if len(start):
        # The shard's text: the runs, each closed by symbol 1; origin: the word of each symbol.
        total = length + 1
        base = np.cumsum(total) - total
        offset = np.arange(int(total.sum())) - np.repeat(base, total)
        origin = np.repeat(start, total) + offset
        closing = offset == np.repeat(length, total)
        seq = np.where(closing, 1, symbol[np.minimum(origin, len(symbol) - 1)])
        index = FMIndex(seq, phrases.sigma)
        pairs = []
        for n, (windows, owners) in phrases.windows.items():
            which, lo, hi = index.search(windows)
            count = hi - lo
            rows = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            first = origin[index.locate(rows)]
            np.add.at(cover, first, 1)
            np.add.at(cover, first + n, -1)
            hit = np.unique(np.stack([w.doc[first], np.repeat(which, count)]), axis=1)
            if hit.shape[1]:
                size = np.array([len(owners[k]) for k in hit[1]])
                pairs.append(np.stack([np.repeat(hit[0], size), np.concatenate([owners[k] for k in hit[1]])]))
        if pairs:
            both = np.unique(np.concatenate(pairs, axis=1), axis=1)
            for d in np.unique(both[0]):
                items[d] = both[1][both[0] == d]
    return w, np.cumsum(cover[:-1]) > 0, items


def _n_blocks(benchmark: DataFrame, block_bytes: int) -> int:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first().n
    return max(1, -(-size // block_bytes))


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks of about ``block_bytes``: one, unless its size asks for more."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = _n_blocks(benchmark, block_bytes)
    own = own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield [(r.item_id, r.text) for r in own.where(F.col("block") == k).collect()]


_PART = "doc_id long, key long, n_words long, spans array<struct<first:long,last:long>>, items array<string>"


def _search(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int) -> DataFrame:
    """Per document row its words, the merged spans of covered words (last exclusive) and the items."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        names = np.array([x if x is not None else "" for x in phrases.ids], object)
        known = np.array([x is not None for x in phrases.ids], bool)
        for part in T.slices(batches):
            w, hit, found = find_spans(part, phrases)
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            # A span ends where its document does.
            border = np.zeros(len(hit) + 1, bool)
            border[w.offsets] = True
            inner = np.flatnonzero(border[1:-1] & hit[1:] & hit[:-1]) + 1 if len(hit) else np.zeros(0, np.int64)
            first = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
            last = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
            doc = w.doc[first] if len(first) else first
            base = w.offsets[doc]
            bounds = np.searchsorted(doc, np.arange(part.n + 1))
            pair = pa.StructArray.from_arrays([pa.array(first - base), pa.array(last - base)], ["first", "last"])
            spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pair)
            named = [sorted({str(names[i]) for i in x if known[i]}) for x in found]
            arrays = [part.batch.column(0), part.batch.column(1), pa.array(w.counts.astype(np.int64)), spans, pa.array(named, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n_words", "spans", "items"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, _PART)


def removal_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key, n_words, spans, items): one row per document row, spans merged and in order."""
    found = [_search(docs, items, window) for items in _blocks(benchmark, block_bytes)]
    if len(found) == 1:
        return found[0]
    tables = [materialise(x, "spans") for x in found]
    hits = tables[0].where(F.size("spans") > 0)
    for x in tables[1:]:
        hits = hits.unionByName(x.where(F.size("spans") > 0))
    # Spans of a document are few; only documents with any are grouped. Copies of a row repeat their spans, which merging absorbs.
    start = F.array_sort(F.flatten(F.collect_set("spans")))
    merged = F.aggregate(
        start,
        F.array().cast("array<struct<first:long,last:long>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["last"] >= s["first"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], s["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(s))),
    )
    joined = hits.groupBy("doc_id", "key").agg(merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    left = tables[0].select("doc_id", "key", "n_words")
    return left.join(joined, left.doc_id.eqNullSafe(joined.doc_id) & (left.key == joined.key), "left").select(left.doc_id, left.key, "n_words", F.coalesce("spans", F.array().cast("array<struct<first:long,last:long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """Per document: words, words hit, items found, and whether at least ``percent`` of its words are hit."""
    found = removal_spans(docs, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that aren't contaminated, with all their columns; one pass while the benchmark is one block."""
    blocks = list(_blocks(benchmark, block_bytes)) if _n_blocks(benchmark, block_bytes) == 1 else []
    if not blocks:
        bad = contamination_keys(docs, benchmark, window, percent, block_bytes)
        own = docs.withColumn("_key", F.xxhash64("text"))
        return own.join(bad, own.doc_id.cast("long").eqNullSafe(bad.doc_id) & (own["_key"] == bad.key), "left_anti").drop("_key")
    shared = docs.sparkSession.sparkContext.broadcast(blocks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(shared.value, window)
        for part in T.slices(batches):
            w, hit, _ = find_spans(part, phrases)
            n_hit = T.per_doc_sum(hit, w.offsets)
            yield part.batch.filter(pa.array(~((n_hit > 0) & (100 * n_hit >= percent * w.counts))))

    return docs.mapInArrow(run, docs.schema)


def contamination_keys(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, key) of contaminated documents; key tells rows of one doc_id apart by their text."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    found = removal_spans(docs, benchmark, window, block_bytes)
    return found.where((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).select("doc_id", "key").distinct()


SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS s
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n),
h AS (SELECT p.r, p.i, p.n, win.item_id FROM (SELECT r, i, n, array_to_string(ws[i : i + n - 1], ' ') AS s FROM p) p JOIN win ON p.s = win.s AND p.n = win.n),
c AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN it ON d.r = it.r
"""
