"""Quality rules as a short-circuit cascade.

Each rule names the measurement it needs and a rejection test. Cost (seconds a document) and
selectivity (share rejected) are estimated on the first ``sample_rows`` documents of every partition;
rules are then ordered by rejection per cost, and a rule sees only the documents that earlier ones let
pass. ``measure`` also returns the measurements of every document, so it makes those first; its
verdict comes from the cascade over what the base rules left.
The verdict is a conjunction, so the order never changes a result, only its cost.

Defined cases: a null text counts as a text without words; empty tables give empty results; rows
with equal ids are judged one by one; rules of equal worth keep their listed order; a very long text
is a slice of its own; extra input columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .store import arrow_rows

#: Documents of each partition that costs and selectivities are estimated on.
SAMPLE_ROWS = 16
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


class Measurements:
    """Measurements of some documents of a slice, each made when it is first asked for."""

    def __init__(self, part: T.Slice, rows: np.ndarray | None = None):
        if rows is None:
            self.bytes, self.offsets = part.bytes, part.offsets
        else:
            size = np.diff(part.offsets)[rows]
            self.offsets = np.concatenate([[0], np.cumsum(size)])
            pieces = [part.bytes[part.offsets[r] : part.offsets[r + 1]] for r in rows]
            self.bytes = np.concatenate(pieces) if pieces else part.bytes[:0]
        self._kept: dict[str, object] = {}

    def __getitem__(self, name: str):
        if name not in self._kept:
            self._kept[name] = getattr(self, f"_{name}")()
        return self._kept[name]

    def _words(self) -> T.Words:
        return T.Words(self.bytes, self.offsets, T.NOT_SPACE)

    def _prefix(self) -> T.Prefix:
        return T.Prefix(self.bytes)

    def _n_words(self) -> np.ndarray:
        return self["words"].counts

    def _word_chars(self) -> np.ndarray:
        return T.per_doc_sum((T.NOT_SPACE & T.LEADING)[self.bytes], self.offsets)

    def _n_symbols(self) -> np.ndarray:
        return T.per_doc_sum(_SYMBOL[self.bytes], self.offsets)

    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and document of each line that has a word."""
        n, w = len(self.bytes), self["words"]
        cut = np.flatnonzero(self.bytes == 0x0A)
        start = np.union1d(cut + 1, self.offsets[:-1])
        start = start[start < n]
        end = np.union1d(cut, self.offsets[1:])
        blank = self.bytes[start] == 0x0A
        end = np.where(blank, start, end[np.searchsorted(end, start, side="right").clip(max=len(end) - 1)]) if len(start) else start
        full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end = start[full], end[full]
        return start, end, np.searchsorted(self.offsets, start, side="right") - 1

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self["lines"][2], minlength=len(self.offsets) - 1)

    def _n_dup_lines(self) -> np.ndarray:
        start, end, doc = self["lines"]
        key = self["prefix"].hashes(start, end) ^ T.mix(doc.astype(np.uint64) + np.uint64(1))
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[first] = False
        return np.bincount(doc[again], minlength=len(self.offsets) - 1)

    def _n_repeat_words(self) -> np.ndarray:
        w = self["words"]
        out = np.zeros(len(w.start), bool)
        if len(w.start) >= 3:
            h = self["prefix"].hashes(w.start, w.end)
            at = np.flatnonzero(w.doc[:-2] == w.doc[2:])
            key = T.mix(T.mix(T.mix(h[at]) + h[at + 1]) + h[at + 2]) ^ T.mix(w.doc[at].astype(np.uint64) + np.uint64(1))
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            hit = at[twice]
            for k in range(3):
                out[hit + k] = True
        return T.per_doc_sum(out, w.offsets)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measurements], np.ndarray]


#: The production rules. The first two are the base rules.
RULES = (
    Rule("too_short", lambda m: m["n_words"] < 50),
    Rule("repetitive", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 5 * m["n_words"]),
    Rule("word_length", lambda m: (m["word_chars"] > 20 * m["n_words"]) | (m["word_chars"] < 2 * m["n_words"])),
    Rule("duplicate_lines", lambda m: 10 * m["n_dup_lines"] > 5 * m["n_lines"]),
)
BASE_RULES = RULES[:2]


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected) on the first ``sample_rows`` documents of every partition, timed on the executors."""

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = sample_rows
        for batch in batches:
            yield batch.slice(0, left)
            left -= batch.num_rows
            if left <= 0:
                return  # the task ends here, the rest of its partition is not read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(head(batches)):
            rows = []
            for rule in rules:
                began = time.thread_time()
                rejected = int(rule.rejects(Measurements(part)).sum())
                rows.append((rule.name, time.thread_time() - began, rejected, part.n))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["rule", "seconds", "rejected", "n"])

    sample = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "rule string, seconds double, rejected long, n long")
    with arrow_rows(docs.sparkSession, sample_rows):
        found = sample.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n")).collect()
    return [(x.rule, x.s / x.n, x.r / x.n) for x in found]


def order_rules(rules: tuple[Rule, ...], estimates: list[tuple[str, float, float]]) -> tuple[Rule, ...]:
    """Most rejection per cost first; rules without an estimate keep their place at the end."""
    worth = {name: share / max(cost, 1e-9) for name, cost, share in estimates}
    return tuple(sorted(rules, key=lambda r: -worth.get(r.name, -1.0)))


def cascade(part: T.Slice, rules: tuple[Rule, ...], passed: np.ndarray | None = None, seen: Measurements | None = None) -> np.ndarray:
    """Which documents of a slice pass all rules; each rule measures only those that are left.

    ``passed``: those that the cascade starts with; ``seen``: measurements made before.
    """
    passed = np.ones(part.n, bool) if passed is None else passed.copy()
    seen = seen or Measurements(part)
    for rule in rules:
        left = np.flatnonzero(passed)
        if not len(left):
            break
        if 2 * len(left) < part.n:
            passed[left] = ~rule.rejects(Measurements(part, left))
        else:
            passed &= ~rule.rejects(seen)
    return passed


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, kept): the cascade alone, with nothing measured that it doesn't need."""
    ordered = order_rules(rules, estimate(docs, rules, sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            yield pa.RecordBatch.from_arrays([part.batch.column(0), pa.array(cascade(part, ordered))], ["doc_id", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, kept boolean")


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document the measurements, whether a base rule fails, and the cascade's verdict.

    The measurements are part of the result, so they are made for all; the verdict is the cascade's, in
    the estimated order, over those that no base rule rejected.
    """
    extra = tuple(r for r in rules if r not in BASE_RULES)
    ordered = order_rules(extra, estimate(docs, extra, sample_rows))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches):
            m = Measurements(part)
            failed = np.zeros(part.n, bool)
            for rule in BASE_RULES:
                failed |= rule.rejects(m)
            kept = cascade(part, ordered, ~failed, m)
            arrays = [part.batch.column(0), *(pa.array(m[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM g),
g3 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g2) WHERE c >= 2),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g3) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n, count(*) AS m FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(dup.m, 0) AS n_lines
  FROM w LEFT JOIN rep ON w.r = rep.r LEFT JOIN dup ON w.r = dup.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > 5 * n_words
       OR word_chars > 20 * n_words OR word_chars < 2 * n_words OR 10 * n_dup_lines > 5 * n_lines) AS kept
FROM m
"""
