"""Vectors as integers: which rows can be used, and blocks of them with a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of 32-bit components in a block.
BLOCK_BYTES = 4 << 20
MIN_ROWS, MAX_ROWS = 256, 1 << 15
#: Blocks, and vectors, that go to a Python worker at once.
BLOCKS_AT_ONCE, VECTORS_AT_ONCE = 4, 2048
SCALE = 256.0
#: Scaled components are held within this distance of zero, so that sums of products fit 64 bits.
LIMIT = 1 << 26


def usable(vector: Column) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    return vector.isNotNull() & ~odd


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), held within ``LIMIT``."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int32)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of scaled components) for each length among a batch's vectors."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        at = start[rows][:, None] + np.arange(dim)
        yield rows, scaled(values[at]).reshape(len(rows), int(dim))


def rows_of(dim: int) -> int:
    """How many vectors of a length make a block."""
    return int(min(MAX_ROWS, max(MIN_ROWS, BLOCK_BYTES // (4 * max(1, dim)))))


def blocks(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """(matrix, the rows' other columns): vectors of one length each, at most ``rows_of`` of them."""
    held: dict[int, list] = {}
    for batch in batches:
        at = batch.schema.get_field_index(vector)
        rest = batch.drop_columns([vector])
        for rows, matrix in by_length(batch.column(at)):
            dim = matrix.shape[1]
            parts = held.setdefault(dim, [])
            parts.append((matrix, rest.take(pa.array(rows))))
            while sum(len(m) for m, _ in parts) >= (most := rows_of(dim)):
                full, others = _joined(parts)
                yield full[:most], others.slice(0, most)
                parts[:] = [(full[most:], others.slice(most))] if len(full) > most else []
    for parts in held.values():
        if parts:
            yield _joined(parts)


def _joined(parts: list) -> tuple[np.ndarray, pa.RecordBatch]:
    if len(parts) == 1:
        return parts[0]
    table = pa.Table.from_batches([r for _, r in parts]).combine_chunks()
    return np.concatenate([m for m, _ in parts]), table.to_batches()[0]
