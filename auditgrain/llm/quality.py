"""Quality by a byte-level convolutional network in numpy.

A text is cut into halves of 256 bytes; two neighbouring halves are a chunk, so chunks overlap and cover the whole text.  A symbol
is a byte with a mark if its five bytes stood up to 24 bytes before too.  Symbols are embedded, learned filters of eight
symbols pass over the text (every second position), each filter's largest value in a chunk goes through a hidden layer, and the mean
and the maximum over all chunks of a text are combined into one probability.

The network is trained on the driver on chunks of a bounded sample of labelled texts; scoring reads every byte."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekit import slices, text_buffer

HALF, WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 256, 8, 2, 8, 24, 16
#: A symbol is marked if the ECHO bytes from it on stood up to NEAR bytes before.
ECHO, NEAR, SYMBOLS = 5, 24, 512
#: Labelled texts that the network is trained on, about, half of each label, and chunks of a text in training (evenly spread).
FIT_DOCS, FIT_CHUNKS = 2_400, 6
EPOCHS, BATCH = 10, 48
#: Halves that pass the filters at a time; bounds the memory of a step.
STEP = 16


class Model(NamedTuple):
    tables: np.ndarray  # WIDTH x SYMBOLS x FILTERS: what a symbol at an offset adds to each filter
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray  # of the mean, then of the maximum over chunks
    out_bias: float


def _symbols(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes, with 256 added where the same ECHO bytes stood a little before in the same text."""
    out = raw.astype(np.uint16)
    n = len(raw) - ECHO + 1
    if n > 0:
        word = np.zeros(n, dtype=np.uint64)
        for k in range(ECHO):
            word = (word << np.uint64(8)) | raw[k : k + n]
        marked = np.zeros(n, dtype=bool)
        for d in range(1, min(NEAR, n - 1) + 1):
            same = word[d:] == word[:-d]
            before = (offsets[:-1, None] - d + np.arange(d)).ravel()  # what stood before is of another text here
            same[before[(before >= 0) & (before < len(same))]] = False
            marked[d:] |= same
        out[:n] += marked.astype(np.uint16) << 8
        tail = (offsets[1:, None] - 1 - np.arange(ECHO - 1)).ravel()  # what follows here is of another text
        out[tail[tail >= 0]] &= 255
    return out


def _halves(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Halves of all texts in symbols, with those that a filter reads beyond them, and the number of halves of each text.

    The rest of a last half, and an empty text's only half, is zeros."""
    raw = _symbols(raw, offsets)
    size = np.diff(offsets)
    count = np.maximum(-(-size // HALF), 1)
    first = np.cumsum(count) - count
    flat = np.zeros(int(count.sum()) * HALF, dtype=np.uint16)
    if len(raw):
        flat[np.arange(len(raw)) + np.repeat(first * HALF - offsets[:-1], size)] = raw
    block = flat.reshape(-1, HALF)
    rows = np.zeros((len(block), HALF + WIDTH - 1), dtype=np.uint16)
    rows[:, :HALF] = block
    rows[:-1, HALF:] = block[1:, : WIDTH - 1]
    rows[first[1:] - 1, HALF:] = 0
    return rows, count


def _filtered(rows: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """The largest value of each filter over the positions of each half."""
    out = np.empty((len(rows), tables.shape[2]), dtype=np.float32)
    for start in range(0, len(rows), STEP):
        part = rows[start : start + STEP]
        total = tables[0].take(part[:, :HALF:STRIDE], axis=0)
        for k in range(1, WIDTH):
            total += tables[k].take(part[:, k : k + HALF : STRIDE], axis=0)
        out[start : start + STEP] = total.max(axis=1)
    return out


def _logits(part: pa.RecordBatch, m: Model) -> np.ndarray:
    rows, count = _halves(*text_buffer(part.column("text")))
    top = _filtered(rows, m.tables)
    first = np.cumsum(count) - count
    both = np.maximum(top, np.concatenate([top[1:], top[-1:]]))  # a half and the next one are a chunk
    last = first + count - 1
    both[last] = top[last]
    keep = np.ones(len(top), dtype=bool)
    keep[last[count > 1]] = False  # the last half is in the chunk before
    chunks = np.maximum(count - 1, 1)
    at = np.cumsum(chunks) - chunks
    h = np.maximum(np.maximum(both[keep] + m.bias, 0) @ m.hidden + m.hidden_bias, 0)
    pooled = np.concatenate([np.add.reduceat(h, at, axis=0) / chunks[:, None], np.maximum.reduceat(h, at, axis=0)], axis=1)
    return pooled @ m.out + m.out_bias


def _sample_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label and evenly spread chunks of each text, one after the other, with the bytes read beyond them."""
    for part in slices(batches):
        rows, count = _halves(*text_buffer(part.column("text")))
        first = np.cumsum(count) - count
        out = []
        for f, n in zip(first.tolist(), count.tolist(), strict=True):
            starts = np.unique(np.linspace(0, max(n - 2, 0), min(FIT_CHUNKS, max(n - 1, 1))).round().astype(int)) + f
            after = rows[np.minimum(starts + 1, f + n - 1)].copy()
            after[starts + 1 > f + n - 1] = 0
            out.append(np.concatenate([rows[starts, :HALF], after], axis=1).tobytes())
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality"), pa.array(out, pa.binary())], names=["doc_id", "quality", "chunks"])


def _train(chunks: np.ndarray, count: np.ndarray, target: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 7, rate: float = 4e-3) -> Model:
    """Adam on the weighted log loss; ``chunks`` of all texts one after the other, ``count`` of each text."""
    rng = np.random.default_rng(seed)
    p = {
        "e": rng.normal(0, 0.5, (SYMBOLS, EMBED)), "w": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)), "b": np.zeros(FILTERS),
        "h": rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)), "c": np.full(HIDDEN, 0.1), "o": rng.normal(0, HIDDEN**-0.5, 2 * HIDDEN), "d": np.zeros(1),
    }
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    first, steps = np.cumsum(count) - count, 0
    span = 2 * HALF
    for epoch in range(epochs):
        order = rng.permutation(len(count))
        for start in range(0, len(order), BATCH):
            docs = order[start : start + BATCH]
            n = count[docs]
            at = np.cumsum(n) - n
            x = chunks[np.arange(n.sum()) - np.repeat(at, n) + np.repeat(first[docs], n)]
            tables = (p["e"] @ p["w"]).astype(np.float32)
            top, where = np.empty((len(x), FILTERS), dtype=np.float32), np.empty((len(x), FILTERS), dtype=np.int64)
            for s in range(0, len(x), STEP // 2):
                part = x[s : s + STEP // 2]
                total = tables[0].take(part[:, :span:STRIDE], axis=0)
                for k in range(1, WIDTH):
                    total += tables[k].take(part[:, k : k + span : STRIDE], axis=0)
                where[s : s + STEP // 2] = total.argmax(axis=1)
                top[s : s + STEP // 2] = total.max(axis=1)
            a = np.maximum(top + p["b"], 0)
            h = np.maximum(a @ p["h"] + p["c"], 0)
            mean, high = np.add.reduceat(h, at, axis=0) / n[:, None], np.maximum.reduceat(h, at, axis=0)
            z = np.concatenate([mean, high], axis=1) @ p["o"] + p["d"]
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[docs]) * weight[docs] / len(docs)
            g = {"o": np.concatenate([mean, high], axis=1).T @ err, "d": np.array([err.sum()])}
            owner = np.repeat(np.arange(len(docs)), n)
            gh = (err / n)[owner][:, None] * p["o"][:HIDDEN]
            largest = h == high[owner]
            ties = np.add.reduceat(largest.astype(float), at, axis=0)[owner]
            gh = (gh + largest / ties * err[owner][:, None] * p["o"][HIDDEN:]) * (h > 0)
            g["h"], g["c"] = a.T @ gh, gh.sum(axis=0)
            ga = (gh @ p["h"].T) * (a > 0)
            g["b"] = ga.sum(axis=0)
            row, slot = np.nonzero(ga)
            pos, value = where[row, slot] * STRIDE, ga[row, slot]
            gt = np.stack([np.bincount(x[row, pos + k].astype(np.int64) * FILTERS + slot, weights=value, minlength=SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS) for k in range(WIDTH)])
            g["w"] = p["e"].T @ gt
            g["e"] = (gt @ p["w"].transpose(0, 2, 1)).sum(axis=0)
            steps += 1
            lr = rate * min(1.0, steps / 20) * (1 - 0.9 * epoch / epochs)
            for k in p:
                g[k] = g[k] + 1e-4 * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= lr * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.999**steps)) + 1e-8)
    f = np.float32
    return Model((p["e"] @ p["w"]).astype(f), p["b"].astype(f), p["h"].astype(f), p["c"].astype(f), p["o"].astype(f), float(p["d"][0]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_docs: int = FIT_DOCS) -> Model:
    """Network from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality) of the rows where ``learn`` (on doc_id) holds.

    About half of ``max_docs`` texts of each label take part (all, if fewer), chosen by a hash of doc_id; weights restore the
    labels' shares.  The driver gets at most FIT_CHUNKS chunks of each.  A doc_id that is repeated in labels has the
    highest of its labels.  Without labelled rows of both kinds the score is the share of label 1 (0.5 without any)."""
    given = labels.where(learn & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    totals = {r["quality"]: r["n"] for r in given.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(totals.values())
    share = {k: min(1.0, max_docs / 2 / max(v, 1)) for k, v in totals.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = given.where(F.when(F.col("quality") == 1, place < int(share.get(1, 0) * 1_000_000)).otherwise(place < int(share.get(0, 0) * 1_000_000)))
    # bounded by max_docs, so fit for broadcast
    sample = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").mapInArrow(_sample_chunks, "doc_id long, quality int, chunks binary")
    rows = sample.toArrow()
    rows = rows.sort_by([("doc_id", "ascending"), ("chunks", "ascending")]) if rows.num_rows else rows
    target = np.asarray(rows.column("quality"), dtype=float)
    if not 0 < target.sum() < len(target):
        p = (totals.get(1, 0) + 0.5) / (n + 1)
        z = np.zeros
        return Model(z((WIDTH, SYMBOLS, FILTERS), np.float32), z(FILTERS), z((FILTERS, HIDDEN)), z(HIDDEN), z(2 * HIDDEN), float(np.log(p / (1 - p))))
    kinds = [target == k for k in (0, 1)]
    weight = np.select(kinds, [totals[k] / n / on.mean() for k, on in enumerate(kinds)])
    data = rows.column("chunks").to_pylist()
    size = 2 * HALF + WIDTH - 1
    chunks = np.frombuffer(b"".join(data), dtype=np.uint16).reshape(-1, size)
    return _train(chunks, np.array([len(d) // (2 * size) for d in data]), target, weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text); the score rises with the chance of label 1.

    A null text counts as an empty one, which is a chunk of zeros.  Rows are independent; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH tables of SYMBOLS x FILTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            z = _logits(part, shared.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
