"""Sums of products of whole numbers, exact at any size, for Arrow batches of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of whole numbers (int64), exact: as doubles while every sum stays below 2^53, else as Python numbers."""
    most = [int(np.abs(x).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of ``column``, all of ``width`` entries and without nulls, as rows."""
    values = pc.list_flatten(column)
    return np.asarray(values, dtype=np.int64).reshape(-1, width)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, none empty."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
