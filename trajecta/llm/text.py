"""Vectorised word splitting and hashing over the UTF-8 bytes of an Arrow batch.

Every function works on whole texts. A batch is cut into slices of about ``SLICE_BYTES`` at
document borders, so memory follows the slice (or one single longer document), not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_BYTES = np.arange(256)
#: Bytes that belong to a word of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Bytes that belong to a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after lower-casing A-Z).
ALPHANUMERIC = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: Lower-cases A-Z and leaves all other bytes.
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
#: First bytes of code points.
LEADING = (_BYTES & 0xC0) != 0x80

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for k, base in enumerate((_FACTOR, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Hashes of any byte ranges of a buffer, from one pass over it."""

    def __init__(self, buf: np.ndarray):
        power, self._inverse = _power_tables(len(buf) + 1)
        self._sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[buf] * power[:-1], out=self._sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


class Slice:
    """Some documents: their ids, UTF-8 bytes and offsets."""

    def __init__(self, batch: pa.RecordBatch, text: str = "text"):
        self.batch = batch
        column = batch.column(batch.schema.get_field_index(text))
        column = pc.fill_null(column.cast(pa.large_string()), "")
        self.n = len(column)
        raw = column.buffers()
        at = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + self.n + 1] if raw[1] and self.n else np.zeros(self.n + 1, np.int64)
        data = np.frombuffer(raw[2], np.uint8) if raw[2] and raw[2].size else np.zeros(0, np.uint8)
        self.bytes = data[at[0] : at[-1]]
        self.offsets = at - at[0]

    def lowered(self) -> np.ndarray:
        return LOWER[self.bytes]

    def text_bytes(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words:
    """Word ranges of a slice: ``start``/``end`` in bytes, ``offsets`` of each document's words, ``doc`` of each word."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        n = len(buf)
        inside = table[buf]
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | border[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | border[1:])) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)


def distinct_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], pa.Array, np.ndarray]:
    """The distinct words of a buffer with the white space before them, their index at each place, and each document's range of places.

    White space is that of ``NOT_SPACE``; at a document's end it stands alone. Words are compared byte by byte.
    """
    border = np.zeros(len(buf) + 1, bool)
    inside = NOT_SPACE[buf]
    border[1:-1] = inside[:-1] & ~inside[1:]
    border[offsets] = True
    at = np.flatnonzero(border)
    return *_distinct(buf, at), np.searchsorted(at, offsets)


def distinct_bare_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], pa.Array, np.ndarray]:
    """As ``distinct_words``, of the words alone."""
    words = Words(buf, offsets, NOT_SPACE)
    at = np.zeros(len(words.start) + 1, np.int64)
    np.cumsum(words.end - words.start, out=at[1:])
    return *_distinct(buf[NOT_SPACE[buf]], at), words.offsets


def _distinct(buf: np.ndarray, at: np.ndarray) -> tuple[list[bytes], pa.Array]:
    """The distinct ones of consecutive ranges of a buffer, and the index of each range's."""
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
    table = words.dictionary
    cut = np.frombuffer(table.buffers()[1], np.int64, len(table) + 1, 8 * table.offset).tolist() if len(table) else [0]
    data = table.buffers()[2].to_pybytes() if len(table) else b""
    return [data[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], words.indices


def joined_values(values: list[bytes], indices: pa.Array, places: np.ndarray) -> list[bytes]:
    """For each document, the values at its range of places, joined."""
    rows = pa.array(values, pa.large_binary()).take(indices)
    cut = np.frombuffer(rows.buffers()[1], np.int64, len(rows) + 1, 8 * rows.offset)[places].tolist() if len(rows) else [0] * len(places)
    data = memoryview(rows.buffers()[2]) if len(rows) and rows.buffers()[2] else memoryview(b"")
    return [bytes(data[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def per_doc_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges, zero for empty ranges."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut batches into slices of at most ``limit`` bytes of text, or one document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        total, first = 0, 0
        for i, x in enumerate(size):
            if i > first and total + x > limit:
                yield Slice(batch.slice(first, i - first), text)
                total, first = 0, i
            total += int(x)
        yield Slice(batch.slice(first), text)
