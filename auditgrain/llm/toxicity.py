"""Toxicity by weak supervision.

1.  Lexicons are mined on a bounded sample of labelled rows: words and six-byte strings
    that stand far more often in toxic texts.  Groups of them are *voters* (toxic, clean, abstain); so are a given
    lexicon of insults and patterns of shouting, which owe nothing to the labels.
2.  A generative label model estimates each voter's behaviour given the hidden label by
    expectation-maximisation; pairs of voters that agree beyond what the label explains are
    correlated and share their weight.  The given label is one more voter.  It starts the rounds; its reliability is
    estimated too, with a prior that weighs as much as the votes: so it ties the hidden label to toxicity rather than to whatever else voters share.
3.  A linear classifier is trained on the posterior labels; it alone scores texts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekit import Poly, list_array, lower_ascii, slices, text_buffer, trimmed, word_spans
from .scratch import checkpointed

BUCKETS = 1 << 20
GRAM = 6
#: Labelled rows that the model is fitted on, about; chosen by a hash of doc_id.
FIT_DOCS = 20_000
FEATURES = 3_000
#: Of them, how many make up the lexicons that vote.
LEXICON = 300
#: Words of a voter that is not mined from the labels.
INSULTS = ("idiot", "stupid", "moron", "scum", "filth", "vermin", "trash", "loser", "pathetic", "worthless", "disgusting", "hate", "kill", "bastard", "bitch", "fuck", "shit", "crap", "damn", "whore")
_TRIM = np.zeros(256, dtype=bool)
_TRIM[list(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~")] = True


class Model(NamedTuple):
    buckets: np.ndarray  # of the features, rising
    weights: np.ndarray  # features, then the dense inputs, then the bias


def _features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets with their rows (repeats included), and dense inputs of each row."""
    raw, offsets = text_buffer(part.column("text"))
    low = lower_ascii(raw)
    starts, ends, first = word_spans(raw, offsets)
    rows = part.num_rows
    n_words = np.diff(first)
    row = np.repeat(np.arange(rows), n_words)
    begin, stop = trimmed(low, starts, ends, _TRIM)
    solid = begin < stop
    poly = Poly(low)
    words = (poly.ranges(begin[solid], stop[solid]) >> np.uint64(45)) | np.uint64(1 << 19)
    word_rows = row[solid]
    grams = poly.grams(GRAM)
    if len(grams):
        end_of = np.zeros(len(low), dtype=np.int64)
        end_of[starts] = ends
        np.maximum.accumulate(end_of, out=end_of)
        at = np.flatnonzero(np.arange(len(grams)) + GRAM <= end_of[: len(grams)])
        gram_rows = np.searchsorted(offsets, at, side="right") - 1
        grams = grams[at] >> np.uint64(45)
    else:
        gram_rows = np.zeros(0, dtype=np.int64)
    loud = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw >= 65) & (raw <= 90), out=loud[1:])
    big = (loud[stop] - loud[begin] == stop - begin) & (stop - begin >= 3)  # words of capitals
    capitals = np.bincount(row[big], minlength=rows) / np.maximum(n_words, 1)
    shout = np.bincount(np.searchsorted(offsets, np.flatnonzero(raw == 33), side="right") - 1, minlength=rows) if len(raw) else np.zeros(rows)
    dense = np.stack([np.log1p(n_words) / 10.0, np.minimum(shout / np.maximum(n_words, 1), 1.0), capitals], axis=1)
    return np.concatenate([words, grams]).astype(np.int64), np.concatenate([word_rows, gram_rows]), dense


def _present(bucket: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket), by row."""
    key = np.unique(row * BUCKETS + bucket)
    return key % BUCKETS, key // BUCKETS


_LUT: dict[int, np.ndarray] = {}


def _slots(buckets: np.ndarray) -> np.ndarray:
    key = hash(buckets.tobytes())
    if key not in _LUT:
        lut = np.full(BUCKETS, -1, dtype=np.int32)
        lut[buckets] = np.arange(len(buckets))
        _LUT.clear()
        _LUT[key] = lut
    return _LUT[key]


def _hits(part: pa.RecordBatch, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct features of each row: (slot, row), and the dense inputs."""
    bucket, row, dense = _features(part)
    slot = _slots(buckets)[bucket]
    on = slot >= 0
    slot, row = _present(slot[on].astype(np.int64), row[on])
    return slot, row, dense


def label_model(votes: np.ndarray, rounds: int = 30, prior: float = 0.1, anchor: int | None = None, reliability: float = 0.97, trust: float = 1.0) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 for each row of ``votes`` (-1 clean, 0 abstain, 1 toxic), and the estimates.

    Voters are independent given the label but for pairwise correlations, which are estimated from
    what is left of their votes after the posterior; a voter's log-odds count 1 / (1 + its summed positive correlations).
    ``anchor`` is a voter that starts the rounds; its chance to be right when it votes is estimated too, from the
    votes and a prior of ``reliability`` that weighs ``trust`` times as much, and is 0.6 at least: that fixes which label is 1."""
    n, m = votes.shape
    if not n:
        return np.zeros(0), {"weights": np.ones(m), "prior": prior}
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    post = np.clip((votes.sum(axis=1) > 0) * 0.8 + 0.1, 0.1, 0.9)
    if anchor is not None:
        post = np.where(votes[:, anchor] == 0, post, np.where(votes[:, anchor] > 0, reliability, 1 - reliability))
    weights, start = np.ones(m), reliability
    for _ in range(rounds):
        like = []
        for y in (post, 1 - post):
            c = (one_hot * y[:, None, None]).sum(axis=0) + 0.5
            like.append(c / c.sum(axis=1, keepdims=True))
        if anchor is not None:
            spoken = float((votes[:, anchor] != 0).sum())
            right_now = float(post[votes[:, anchor] > 0].sum() + (1 - post)[votes[:, anchor] < 0].sum())
            right = max(0.6, (right_now + trust * spoken * start) / max((1 + trust) * spoken, 1e-9)) if spoken else start
            reliability = min(right, 0.999)
            for table, right in zip(like, (2, 0), strict=True):
                spoken = 1 - table[anchor, 1]
                table[anchor, 2 - right], table[anchor, right] = spoken * (1 - reliability), spoken * reliability
        prior = float(np.clip(post.mean(), 0.01, 0.5))
        mean = [(like[k] * np.array([-1, 0, 1])).sum(axis=1) for k in (0, 1)]
        rest = votes - (post[:, None] * mean[0] + (1 - post)[:, None] * mean[1])
        sd = rest.std(axis=0) + 1e-9
        rho = (rest.T @ rest) / n / np.outer(sd, sd)
        np.fill_diagonal(rho, 0)
        weights = 1 / (1 + np.where(rho > 0.1, rho, 0).sum(axis=1))
        if anchor is not None:
            weights[anchor] = 1
        odds = np.log(like[0]) - np.log(like[1])
        logit = np.log(prior / (1 - prior)) + (one_hot * (odds * weights[:, None])[None]).sum(axis=(1, 2))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, {"weights": weights, "prior": prior, "correlation": rho, "given_toxic": like[0], "given_clean": like[1], "anchor": reliability}


def _votes(slot: np.ndarray, row: np.ndarray, n: int, n_slots: int, is_word: np.ndarray, strong: np.ndarray, given: np.ndarray, dense: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Voters over the strongest mined features, the given lexicon and patterns; the given label votes last."""
    cols = [np.where(np.bincount(row[given[slot]], minlength=n) > 0, 1, 0)]
    on = strong[slot]
    slot, row = slot[on], row[on]
    group = np.arange(n_slots) % 3
    for word in (True, False):  # lexicon voters: three of words, three of strings
        for g in range(3):
            mine = (is_word[slot] == word) & (group[slot] == g)
            count = np.bincount(row[mine], minlength=n)
            cols.append(np.where(count > 0, 1, 0))
    hits = np.bincount(row, minlength=n)
    cols += [
        np.where(hits == 0, -1, np.where(hits >= 3, 1, 0)),
        np.where(hits / np.maximum(np.expm1(dense[:, 0] * 10), 1) > 0.01, 1, np.where(hits == 0, -1, 0)),
        np.where(dense[:, 1] > 0.2, 1, 0),  # pattern: an exclamation mark every fifth word
        np.where(dense[:, 2] > 0.3, 1, 0),  # pattern: every third word in capitals
        np.where(label == 1, 1, np.where(label == 0, -1, 0)),
    ]
    return np.stack(cols, axis=1)


def _train(slot: np.ndarray, row: np.ndarray, dense: np.ndarray, target: np.ndarray, n_slots: int, rounds: int = 400, l2: float = 2e-4) -> np.ndarray:
    """Logistic regression by Adam on sparse 0/1 features and the dense inputs."""
    n, d = dense.shape
    w = np.zeros(n_slots + d + 1)
    w[-1] = np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3)) if n else -3.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1 if n else 1):
        z = np.bincount(row, weights=w[slot], minlength=n) + dense @ w[n_slots:-1] + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        g = np.concatenate([np.bincount(slot, weights=err[row], minlength=n_slots), dense.T @ err, [err.sum()]])
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, max_docs: int = FIT_DOCS, features: int = FEATURES, insults: tuple[str, ...] = INSULTS) -> Model:
    """Model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic) of the rows where ``learn`` (on doc_id) holds.

    At most about ``max_docs`` labelled rows take part; the driver gets the numbers of their features as arrays.
    A doc_id that is repeated in labels has the highest of its labels; repeated in docs, each row counts."""
    given = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_docs / max(given.count(), 1))
    if share < 1:
        given = given.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # bounded by max_docs, so fit for broadcast
    sample = checkpointed(docs.select("doc_id", "text").join(F.broadcast(given), "doc_id"))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, BUCKETS), dtype=np.int64)
        for part in slices(batches):
            bucket, row, _ = _features(part)
            bucket, row = _present(bucket, row)
            toxic = np.asarray(part.column("toxic"))[row]
            for k in (0, 1):
                seen[k] += np.bincount(bucket[toxic == k], minlength=BUCKETS)
        used = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(seen[1][used]), pa.array(seen[0][used])], names=["bucket", "t", "c"])

    p = n1 / max(n1 + n0, 1)
    spread_ = F.sqrt(F.greatest((F.col("t") + F.col("c")) * F.lit(p * (1 - p)), F.lit(1e-9)))
    z = (F.col("t") - (F.col("t") + F.col("c")) * F.lit(p)) / spread_
    top = (
        sample.select("text", "toxic").mapInArrow(count, "bucket int, t long, c long").groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .where("t >= 3").withColumn("z", z).where("z > 5").orderBy(F.desc("z"), "bucket").limit(features).collect()
    )
    named = pa.RecordBatch.from_arrays([pa.array([" ".join(insults)])], names=["text"])
    seeds = _present(*_features(named)[:2])[0]
    seeds = seeds[seeds >= 1 << 19]
    buckets = np.union1d(np.array([r["bucket"] for r in top], dtype=np.int64), seeds)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            slot, row, dense = _hits(part, buckets)
            slots = list_array(pa.array(slot, pa.int32()), np.bincount(row, minlength=part.num_rows))
            values = list_array(pa.array(dense.ravel()), np.full(part.num_rows, dense.shape[1]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("toxic"), slots, values], names=["doc_id", "toxic", "slots", "dense"])

    rows = sample.mapInArrow(found, "doc_id long, toxic int, slots array<int>, dense array<double>").orderBy("doc_id", F.hash("slots")).toArrow()
    lists = rows.column("slots").combine_chunks()
    slot = np.asarray(lists.flatten()).astype(np.int64)
    row = np.repeat(np.arange(rows.num_rows), np.asarray(lists.value_lengths()))
    dense = np.asarray(rows.column("dense").combine_chunks().flatten()).reshape(rows.num_rows, 3)
    label = np.asarray(rows.column("toxic"))
    is_word = buckets >= 1 << 19
    strong = np.isin(buckets, [r["bucket"] for r in top[:LEXICON]])
    votes = _votes(slot, row, rows.num_rows, len(buckets), is_word, strong, np.isin(buckets, seeds), dense, label)
    posterior, _ = label_model(votes, anchor=votes.shape[1] - 1)
    return Model(buckets, _train(slot, row, dense, posterior, len(buckets)))


def _logits(part: pa.RecordBatch, m: Model) -> np.ndarray:
    k = len(m.buckets)
    slot, row, dense = _hits(part, m.buckets)
    return np.bincount(row, weights=m.weights[slot], minlength=part.num_rows) + dense @ m.weights[k:-1] + m.weights[-1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text); the score rises with the chance of label 1.

    Null and empty texts have no features and get the score of the bias.  Rows are independent; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            z = _logits(part, shared.value)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those scored ``threshold`` or more; columns as given."""
    model = fit(docs, labels, learn)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(_logits(part, shared.value) < np.log(threshold / (1 - threshold)))).select(names)

    return docs.mapInArrow(run, docs.schema)
