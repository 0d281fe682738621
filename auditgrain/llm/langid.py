"""Language identification as a mixture: each text's language proportions by expectation-maximisation.

Byte trigrams of words give every word a likelihood in each language; EM estimates the proportions of
languages in a text from its words.  Candidate sets of languages come from backward elimination: from all
languages, the one of the least share goes and EM is run again on the rest, down to one.  The set chosen is the
one of highest likelihood less half a log of the number of words for each language (BIC)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytekit import lower_ascii, slices, text_buffer

BUCKETS = 1 << 16
ROUNDS = 8
#: Texts that the trigram model is fitted on, about; chosen by a hash of doc_id.
FIT_DOCS = 12_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all letter bytes, where each word begins among them, and each word's row."""
    raw = lower_ascii(raw)
    n = len(raw)
    if n == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    letter = _LETTER[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begin = letter.copy()
    begin[1:] &= ~letter[:-1] | edge[1:n]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | edge[1:n]
    at = np.flatnonzero(letter)
    wide = raw.astype(np.uint32)
    before = np.full(n, 32, dtype=np.uint32)
    before[1:] = wide[:-1]
    before[begin] = 32
    after = np.full(n, 32, dtype=np.uint32)
    after[:-1] = wide[1:]
    after[last] = 32
    gram = ((before << np.uint32(16)) | (wide << np.uint32(8)) | after)[at]
    code = (gram * np.uint32(0x9E3779B1)) >> np.uint32(16)
    starts = np.flatnonzero(begin[at])
    return code, starts, np.searchsorted(offsets, at[starts], side="right") - 1


def fit(docs: DataFrame, learn: Column, max_docs: int = FIT_DOCS, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood table) from the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds.

    At most about ``max_docs`` rows, chosen by a hash of doc_id, are counted; what reaches the driver is
    one number for each language and used bucket."""
    pool = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    share = min(1.0, max_docs / max(pool.count(), 1))
    if share < 1:
        pool = pool.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in slices(batches):
            code, starts, row = _words(*text_buffer(part.column("text")))
            lang = np.asarray(part.column("lang").to_pylist(), dtype=object)
            owner = np.repeat(row, np.diff(np.append(starts, len(code))))
            for one in set(lang.tolist()):
                got = np.bincount(code[lang[owner] == one], minlength=BUCKETS)
                counts[one] = counts.get(one, 0) + got
        for one, c in counts.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([one] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(c[used], pa.int64())], names=["lang", "bucket", "n"])

    rows = pool.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    table = np.full((max(len(langs), 1), BUCKETS), smooth)
    for r in rows:
        table[langs.index(r["lang"]), r["bucket"]] += r["n"]
    table = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    return langs, np.ascontiguousarray(table)


def _mixture(p: np.ndarray, starts: np.ndarray, n_words: np.ndarray, rounds: int, share: np.ndarray) -> np.ndarray:
    """Proportions of languages for texts whose words' likelihoods stand one after the other in ``p``, from ``share`` on.

    A language whose share is 0 stays out."""
    for _ in range(rounds):
        r = p * np.repeat(share, n_words, axis=0)
        r /= r.sum(axis=1, keepdims=True)
        share = np.add.reduceat(r, starts, axis=0, dtype=np.float64).astype(np.float32) / n_words[:, None].astype(np.float32)
    return share


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, lang_pred, score, languages array<struct<lang, share>>) for every row of ``docs`` (doc_id, text).

    score is the share of the predicted language.  A null text, one without a letter, or a model without
    languages gives ``und``, score 0 and no languages.  Rows are independent; other columns are not read."""
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1])  # languages x 65,536 floats
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for part in slices(batches):
            pred, score, sets = ["und"] * part.num_rows, np.zeros(part.num_rows), [[] for _ in range(part.num_rows)]
            raw, offsets = text_buffer(part.column("text"))
            code, starts, row = _words(raw, offsets)
            if len(starts) and langs:
                ll = np.stack([np.add.reduceat(t[code], starts) for t in table], axis=1)
                p = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -30.0))
                rows, first, n = np.unique(row, return_index=True, return_counts=True)
                mask = np.ones((len(rows), len(langs)), dtype=bool)
                share = np.full(mask.shape, 1.0 / len(langs), dtype=np.float32)
                best = np.full(len(rows), -np.inf)
                chosen_share = share.copy()
                for k in range(len(langs), 0, -1):
                    share = np.where(mask, np.maximum(share, 1e-6), 0)
                    share = _mixture(p, first, n, rounds, (share / share.sum(axis=1, keepdims=True)).astype(np.float32))
                    fit_ = np.log(np.maximum((p * np.repeat(share, n, axis=0)).sum(axis=1), 1e-30))
                    value = np.add.reduceat(fit_, first, dtype=np.float64) - 0.5 * k * np.log(n + 1.0)
                    better = value > best
                    best[better], chosen_share[better] = value[better], np.where(mask, share, -1)[better]
                    mask[np.arange(len(rows)), np.argmin(np.where(mask, share, np.inf), axis=1)] = False
                order = np.argsort(-chosen_share, axis=1, kind="stable")
                size = (chosen_share >= 0).sum(axis=1)
                letters = np.add.reduceat((raw >= 128).astype(np.int64), np.minimum(offsets[:-1], len(raw) - 1)) if len(raw) else None
                for i, r in enumerate(rows.tolist()):
                    data = raw[offsets[r] : offsets[r + 1]]
                    if letters is not None and letters[r] and not _LETTER[lower_ascii(data)][data < 128].any() and not any(c.isalpha() for c in data.tobytes().decode()):
                        continue
                    sets[r] = [{"lang": langs[c], "share": float(chosen_share[i, c])} for c in order[i, : size[i]]]
                    pred[r], score[r] = sets[r][0]["lang"], min(1.0, sets[r][0]["share"])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(pred), pa.array(score), pa.array(sets, kind)], names=["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang: string, share: double>>")
