"""Vectorised helpers over the UTF-8 bytes of an Arrow batch of texts.

The operators of this subpackage that run Python do so inside ``mapInArrow``:
Spark deals the rows out, and each task works on slices of a few megabytes, so
a task's memory is bounded by the slice (or by its longest single text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

# Odd multipliers of the polynomial and mixing hashes (fixed values).
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
_INV = np.uint64(pow(int(BASE), -1, 1 << 64))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * MIX_A
    h ^= h >> np.uint64(27)
    h *= MIX_B
    h ^= h >> np.uint64(31)
    return h


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        block = (np.cumsum(sizes) - 1) // limit
        edges = np.flatnonzero(np.diff(block)) + 1
        start = 0
        for end in [*edges.tolist(), batch.num_rows]:
            if end > start:
                yield batch.slice(start, end - start)
            start = end


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and offsets (rows + 1); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


_TABLES: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n + 1 at least; kept for the next slice of a usual size."""
    if _TABLES and len(_TABLES[0]) > n:
        return _TABLES[0], _TABLES[1]
    made = []
    for factor in (BASE, _INV):
        table = np.full(max(n, SLICE_BYTES) + 1, factor, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        made.append(table)
    if n <= 4 * SLICE_BYTES:
        _TABLES[:] = made
    return made[0], made[1]


#: From so many bytes on, a range has a cryptographic hash: a polynomial modulo 2^64 gives some pairs of long texts the same value.
LONG = 256


class Poly:
    """Hashes of arbitrary byte ranges of a buffer, equal for equal bytes wherever they stand."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.raw = raw
        power, self.inverse = _powers(n)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        terms = raw.astype(np.uint64)
        terms += np.uint64(1)
        terms *= power[:n]
        np.cumsum(terms, out=self.prefix[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of ``raw[start:end]`` for each pair; the length is mixed in."""
        h = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        h = mix(h + (end - start).astype(np.uint64) * MIX_B)
        for i in np.flatnonzero(end - start >= LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.raw[start[i] : end[i]], digest_size=8).digest(), "little")
        return h

    def grams(self, k: int) -> np.ndarray:
        """Mixed hash of every ``k`` consecutive bytes; one entry for each start."""
        n = len(self.prefix) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.prefix[k:] - self.prefix[: n]) * self.inverse[:n])


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than ASCII white space), and for each
    text the number of its first word (rows + 1 entries)."""
    n = len(raw)
    if n == 0:
        zero = np.zeros(0, dtype=np.int64)
        return zero, zero, np.zeros(len(offsets), dtype=np.int64)
    solid = ~_SPACE[raw]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:n]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:] | first[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def trimmed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the ``marks`` (256 flags) around them; a word of marks alone becomes empty."""
    solid = np.flatnonzero(~marks[raw])
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    some = first <= last
    b, e = ends.copy(), ends.copy()
    b[some], e[some] = solid[first[some]], solid[last[some]] + 1
    return b, e


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Poly(raw).ranges(starts, ends)


def windows(hashes: np.ndarray, first: np.ndarray, size: int, whole_when_short: bool = True):
    """Hashes of ``size`` consecutive words of each text.

    Returns (hash, text number, word number).  A text with fewer words gives its whole
    sequence as one window when ``whole_when_short``; a text without words gives none."""
    counts = np.diff(first)
    n = len(hashes)
    span = np.maximum(counts - size + 1, 0)
    total = int(span.sum())
    row = np.repeat(np.arange(len(counts)), span)
    at = np.arange(total) - np.repeat(np.cumsum(span) - span, span) + first[:-1][row] if total else np.zeros(0, dtype=np.int64)
    acc = np.zeros(total, dtype=np.uint64)
    for k in range(size):
        acc = acc * BASE + hashes[at + k] if total else acc
    acc = mix(acc + np.uint64(size))
    if whole_when_short and n:
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            tail = np.empty(len(short), dtype=np.uint64)
            for j, r in enumerate(short):
                h = np.uint64(0)
                with np.errstate(over="ignore"):
                    for w in hashes[first[r] : first[r + 1]]:
                        h = h * BASE + w
                    tail[j] = mix(np.array([h + np.uint64(counts[r])], dtype=np.uint64))[0]
            acc, row, at = np.concatenate([acc, tail]), np.concatenate([row, short]), np.concatenate([at, first[short]])
    return acc, row, at


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[starts[i] : starts[i] + lengths[i]]`` for each i, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return values[:0]
    at = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    return values[at]


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` from rows sorted by them; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            col = batch.column(k)
            if batch.num_rows > 1:
                change[1:] |= np.asarray(pc.not_equal(col[1:], col[:-1]))
        here = tuple(batch.column(k)[0].as_py() for k in keys)
        edges = np.flatnonzero(change).tolist()
        start = 0
        if held and here != last:
            yield pa.Table.from_batches(held)
            held = []
        for edge in edges:
            held.append(batch.slice(start, edge - start))
            yield pa.Table.from_batches(held)
            held, start = [], edge
        held.append(batch.slice(start))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)
