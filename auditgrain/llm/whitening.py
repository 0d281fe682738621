"""Whitening of embeddings through spectral divide and conquer.

The covariance of the distinct vectors is a sum over Spark's partitions of products of whole numbers, so it is exact and
the same however rows are dealt.  Its eigenvectors come from splitting: the polar factor of the covariance less a shift,
by the dynamically weighted Halley iteration on QR factorisations (QDWH), is the matrix sign, which gives the projector
on the eigenvalues above the shift; a basis of its range and one of the complement turn the matrix into two smaller
ones, until single components are left.  They are broadcast (width squared numbers) and every row is projected."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact import matrix, pieces, products
from .scratch import written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
_EPS = np.finfo(float).eps
_LONG = 1 << 63


class Whitening(NamedTuple):
    n: int  # distinct vectors
    sums: list[int]  # of each dimension
    vectors: np.ndarray  # unit eigenvectors in columns, by falling eigenvalue
    values: np.ndarray
    trace: float


def polar(a: np.ndarray, most: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QDWH."""
    size = np.linalg.norm(a)
    eye = np.eye(len(a))
    if size == 0:
        return eye
    x, low = a / size, _EPS
    for _ in range(most):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        ga = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d))))
        gb = (ga - 1) ** 2 / 4
        gc = ga + gb - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(gc) * x, eye]))
        nxt = gb / gc * x + (ga - gb / gc) / np.sqrt(gc) * (q[: len(a)] @ q[len(a) :].T)
        nxt = (nxt + nxt.T) / 2
        low = min(1.0, low * (ga + gb * low * low) / (1 + gc * low * low))
        moved, x = np.linalg.norm(nxt - x), nxt
        if moved < np.cbrt(5 * _EPS) and 1 - low < 10 * _EPS:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first columns span the eigenvectors above a shift, and their number."""
    k = len(a)
    middle = np.trace(a) / k
    around = np.linalg.norm(a - middle * np.eye(k)) / np.sqrt(k)
    rng = np.random.default_rng(k)
    for step in (0.0, 0.11, -0.13, 0.29, -0.31, 0.53, -0.59, 0.83, -0.87):
        above = (polar(a - (middle + step * around) * np.eye(k)) + np.eye(k)) / 2
        rank = round(float(np.trace(above)))
        if not 0 < rank < k:
            continue
        q, _ = np.linalg.qr(above @ rng.standard_normal((k, rank)))
        q, _ = np.linalg.qr(above @ q, mode="complete")
        if np.linalg.norm(q[:, rank:].T @ a @ q[:, :rank]) <= 50 * k * _EPS * scale:
            return q, rank
    return None


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors in columns) of a symmetric matrix, by falling value."""
    scale = max(float(np.linalg.norm(a)), np.finfo(float).tiny)
    open_, done = [(np.eye(len(a)), a)] if len(a) else [], []
    while open_:
        basis, part = open_.pop()
        rest = part - np.diag(np.diag(part))
        found = None if len(part) == 1 or np.linalg.norm(rest) <= _EPS * scale else _split(part, scale)
        if found is None:  # one component, or values that differ by rounding only
            done.append(basis)
            continue
        q, rank = found
        for cols in (q[:, :rank], q[:, rank:]):
            inner = cols.T @ part @ cols
            open_.append((basis @ cols, (inner + inner.T) / 2))
    v = np.concatenate(done, axis=1) if done else np.zeros((0, 0))
    for _ in range(2):  # what rounding has left between components of different values
        near = np.eye(len(a)) - v.T @ v
        turned = v.T @ a @ v
        value = np.diag(turned) / (1 - np.diag(near))
        gap = value[None, :] - value[:, None]
        apart = np.abs(gap) > 2 * (np.linalg.norm(turned - np.diag(value)) + scale * np.linalg.norm(near))
        turn = np.where(apart, (turned + value[None, :] * near) / np.where(apart, gap, 1), near / 2)
        np.fill_diagonal(turn, np.diag(near) / 2)
        v = v + v @ turn
    value = np.diag(v.T @ a @ v)
    order = np.argsort(-value, kind="stable")
    return value[order], v[:, order]


def whole_vectors(embeddings: DataFrame, column: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector is neither null nor empty and holds finite entries only; x is floor(scale * c) + offset."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.where(v.isNotNull() & (F.size(v) > 0) & finite)
    return rows.select("vec_id", F.transform(v, lambda c: F.floor(c * float(scale)).cast("long") + F.lit(offset)).alias("x"))


def _partials(fit: DataFrame, width: int, centre: list[int] | None) -> DataFrame:
    """(i, j, s): for each task the sums of products of centred entries, or (i, -1, sum) without ``centre``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in pieces(batches):
            x = matrix(part.column("x"), width)
            if centre is not None:
                x = x - np.array(centre, dtype=np.int64)
                got = products(x.T, x.T).astype(object)
            else:
                got = x.astype(object).sum(axis=0)[:, None] if np.abs(x).max() >= _LONG >> 13 else x.sum(axis=0).astype(object)[:, None]
            total = got if total is None else total + got
        if total is not None:
            i, j = np.indices(total.shape)
            keep = (i <= j) if centre is not None else np.ones(i.shape, dtype=bool)
            sums = pa.array([Decimal(int(s)) for s in total[keep]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), sums], names=["i", "j", "s"])

    return fit.mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of ``rows`` (x array<long>), and the fit list: every distinct vector once.

    Vectors of another length than the most frequent one (of two such, the longer) take no part.  The driver gets
    width squared sums.  Components whose eigenvalue is zero to rounding are left out; without rows, or where all
    are equal, there are none (and no whitening without rows)."""
    listed = written(rows.select("x").distinct(), "fit_list")  # combined before the shuffle, so that a frequent vector is no hot key
    sizes = listed.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    if not sizes:
        return None, listed
    width, n = sizes[0]["w"], sizes[0]["n"]
    listed = listed.where(F.size("x") == width)
    sums = [0] * width
    for r in _partials(listed, width, None).collect():
        sums[r["i"]] = int(r["s"])
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the whole numbers next to the means: products of centred entries stay exact
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    cov = np.zeros((width, width))
    for r in _partials(listed, width, centre).collect():
        i, j = r["i"], r["j"]
        cov[i, j] = cov[j, i] = (n * int(r["s"]) - left[i] * left[j]) / (n * n)  # of exact numbers, rounded once
    values, vectors = eigenpairs(cov)
    trace = float(np.trace(cov))
    keep = min(components, int((values > trace * width * _EPS).sum()))
    return Whitening(n, sums, vectors[:, :keep], values[:keep], trace), listed


def _project(x: np.ndarray, w: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n * x - sums, exact, and the whitened coordinates."""
    most = int(np.abs(x).max(initial=0)) * w.n + max(map(abs, w.sums))
    sums = np.array(w.sums, dtype=np.int64 if most < _LONG else object)
    off = w.n * x.astype(sums.dtype) - sums
    return off, (off.astype(float) / w.n) @ w.vectors / np.sqrt(w.values)


def identity_error(listed: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k, width = len(w.values), len(w.sums)
    if not k:
        return 0.0
    shared = listed.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k + 1))
        for part in pieces(batches):
            y = _project(matrix(part.column("x"), width), shared.value)[1]
            total += np.concatenate([y.T @ y, y.sum(axis=0)[:, None]], axis=1)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    got = np.zeros((k, k + 1))
    for r in listed.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        got[r["i"], r["j"]] = r["s"] / w.n
    return float(np.abs(got[:, :k] - np.outer(got[:, k], got[:, k]) - np.eye(k)).max())


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row and component.

    Null or empty vectors, vectors with a null or non-finite entry and vectors of another length than the most frequent
    one are dropped; repeated rows are given as often as they stand; other columns are not read.  ``deviation`` is null
    where it passes a long.  An empty table, or one of equal vectors only, gives no rows."""
    rows = whole_vectors(embeddings, column)
    w, listed = fit(rows, components)
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None or not len(w.values):
        return embeddings.sparkSession.createDataFrame([], kind)
    error, width, k = identity_error(listed, w), len(w.sums), len(w.values)
    shared = embeddings.sparkSession.sparkContext.broadcast(w)
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        share = w.values / w.trace
        for part in pieces(batches):
            off, y = _project(matrix(part.column("x"), width), w)
            if off.dtype == object or float(np.abs(off).max()) ** 2 * width >= _LONG:
                far = [int(s) for s in (off.astype(object) ** 2).sum(axis=1)]
                far = pa.array([s if s < _LONG else None for s in far], pa.int64())
            else:
                far = pa.array((off * off).sum(axis=1))
            m = part.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").cast(pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, w.n)), far.take(each),
                 pa.array(y.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))], names=names)

    return rows.where(F.size("x") == width).mapInArrow(run, kind)
