"""Whitening, quality network and hard negatives against plain numpy or loops, and on odd rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditgrain.llm import exact, hardneg, quality, queries, whitening

EMB = "vec_id long, embedding array<double>, label int, x string, n string, score string, squared string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], EMB)


def odd(rows):
    """Rows with null vectors, null and infinite entries, other lengths, repeated rows and ties beside ``rows``."""
    v = rows[0][1]
    bad = [(901, None, 1), (902, [None] + v[1:], 1), (903, [float("nan")] + v[1:], 1), (904, v[1:] + [float("inf")], 1), (905, v[:-1], 1), (906, [], 1)]
    return rows + bad + rows[:3] + [(907, v, 2)]


def test_products_are_exact():
    rng = np.random.default_rng(0)
    for scale in (10, 1 << 24, 1 << 33):
        a, b = rng.integers(-scale, scale, (5, 7)), rng.integers(-scale, scale, (4, 7))
        assert (exact.products(a, b).astype(object) == a.astype(object) @ b.astype(object).T).all()


@pytest.mark.parametrize("kind", ["random", "projector", "rank", "equal", "diagonal", "swap"])
@pytest.mark.parametrize("n", [1, 2, 3, 16, 40])
def test_eigenpairs(kind, n):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    a = {"random": lambda: (lambda b: b.T @ b)(rng.standard_normal((2 * n, n))), "projector": lambda: (q * np.resize([1.0, 2.0, 2.0], n)) @ q.T, "rank": lambda: (lambda b: b.T @ b)(rng.standard_normal((max(1, n // 3), n))),
         "equal": lambda: 3.0 * np.eye(n), "diagonal": lambda: np.diag(np.arange(n, 0, -1.0)), "swap": lambda: np.full((n, n), 2.0) - np.eye(n)}[kind]()
    a = (a + a.T) / 2
    e, v = whitening.eigenpairs(a)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.abs(e - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * size * n
    assert np.linalg.norm(v.T @ v - np.eye(n)) < 1e-12 and np.linalg.norm(a @ v - v * e) < 1e-13 * size * n


def check_whitening(got, rows):
    keep = [(i, np.floor(64 * np.array(v)) + 1_000_000) for i, v, _ in rows if v and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([v for _, v in keep]).astype(int)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    d = fit - s / n
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1], u[:, ::-1]
    k = int((e > e.sum() * 1e-13).sum())
    want = ((x - s / n) @ u[:, :k] / np.sqrt(e[:k])).round(6)
    got = got.sort_values(["vec_id", "component", "whitened"])
    assert len(got) == len(keep) * k and set(got.component) == set(range(1, k + 1)) and set(got.n) == {n}
    assert got.identity_error.max() < 1e-9 and np.allclose(sorted(set(got.explained), reverse=True), e[:k] / e.sum())
    for c in range(1, k + 1):
        mine = got[got.component == c]
        target = pd.Series(want[:, c - 1]).groupby([i for i, _ in keep]).first()
        values = mine.groupby("vec_id").whitened.first()
        assert np.allclose(values, target, atol=1e-5) or np.allclose(values, -target, atol=1e-5)
    far = {i: sum(int(n * a - b) ** 2 for a, b in zip(v.astype(int).tolist(), s.tolist(), strict=True)) for i, v in keep}
    assert {int(i): int(v) for i, v in got.groupby("vec_id").deviation.first().items()} == far


def test_whitening(spark):
    rng = np.random.default_rng(1)
    rows = odd([(i, (rng.standard_normal(6) * [3, 2, 1, 1, 0.5, 0.2] + 5).tolist(), 0) for i in range(60)])
    check_whitening(whitening.whiten(frame(spark, rows)).toPandas(), rows)
    flat = odd([(i, [*rng.standard_normal(5).tolist(), 1.0], 0) for i in range(40)])  # a component without variance is left out
    check_whitening(whitening.whiten(frame(spark, flat).where("vec_id not in (904)")).toPandas(), [r for r in flat if r[0] != 904])


def test_whitening_of_nothing(spark):
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)]):
        assert whitening.whiten(frame(spark, rows)).count() == 0
    wide = whitening.whiten(frame(spark, [(i, [1e12 * i, float(i % 3)], 0) for i in range(5)])).toPandas()  # beyond what a long holds
    assert wide.deviation.isna().any() and wide.identity_error.max() < 1e-6


def test_op11_over_the_table(spark, sf):
    got = queries.QUERIES["op11_whitening"](spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = (np.floor(64 * np.stack(e.embedding).astype(float)) + 1_000_000).astype(int)
    fit = np.unique(x, axis=0)
    d = fit - fit.sum(axis=0) / len(fit)
    value, vector = np.linalg.eigh(d.T @ d / len(fit))
    want = ((x - fit.sum(axis=0) / len(fit)) @ vector[:, ::-1][:, :16] / np.sqrt(value[::-1][:16]))[np.argsort(e.vec_id)]
    mine = got.sort_values(["vec_id", "component"]).whitened.to_numpy().reshape(-1, 16)
    assert np.abs(mine * np.sign((mine * want).sum(axis=0)) - want).max() < 1e-8


def by_loops(rows, anchors, low=80, high=100, keep=5):
    good = {(i, k, tuple(int(np.floor(256 * c)) for c in v)) for i, v, k in rows if k is not None and v and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for i, k, v in good:
        if not anchors(i):
            continue
        score = {(w, other): sum(a * b for a, b in zip(v, x, strict=True)) for w, other, x in good if w != i}
        best = sorted(((-s, w) for (w, other), s in score.items() if other == k))[:keep]
        for s, w in best:
            near = sorted((-t, r) for (r, other), t in score.items() if other != k and low * -s <= 100 * t <= high * -s)[:keep]
            out += [(i, w, n + 1, r, -s, -t) for n, (t, r) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("bucket,shelf,pack", [(1024, 16, 256), (7, 2, 3), (1, 1, 1)])
@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_hard_negatives(spark, monkeypatch, bucket, shelf, pack, spread):
    """Small buckets and packs, one hot label, tight clusters (ranges prune) and loose ones, ties, repeated rows, zero vectors."""
    monkeypatch.setattr(hardneg, "BUCKET", bucket), monkeypatch.setattr(hardneg, "SHELF", shelf), monkeypatch.setattr(hardneg, "PACK", pack)
    rng = np.random.default_rng(bucket)
    centres = rng.standard_normal((6, 4))
    rows = [(i, (centres[i % 6] + spread * rng.standard_normal(4)).round(1 if i % 2 else 3).tolist(), 0 if i % 3 else i % 5) for i in range(150)]
    rows += [(200 + i, rows[0][1], i % 3) for i in range(8)] + [(300, [0.0] * 4, 1), (310, [0.0] * 4, 0), (400, rows[4][1], None)]
    v = rows[0][1]
    rows += [(901, None, 1), (902, [None] + v[1:], 1), (903, [float("nan")] + v[1:], 1), (905, v[:-1], 1)] + rows[:3]
    table = frame(spark, rows)
    got = hardneg.hard_negatives(table, F.col("vec_id") % 10 == 0).collect()
    assert sorted(tuple(r) for r in got) == by_loops(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_nothing(spark):
    for rows in ([], [(10, [1.0, 2.0], 0)], [(10, [1.0, 2.0], 0), (20, [1.0, 2.0], 1)], [(1, [1.0], 0), (2, [1.0], 0)]):
        assert hardneg.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0).count() == 0


DOCS = "doc_id long, text string, score string, quality string"


def test_quality_symbols():
    """A byte is marked where its five bytes stood up to 24 bytes before in the same text."""
    texts = ["que que que", "abcdefgh", "", "xabcde abcde", "a" * 12, "abcde" + "z" * 25 + "abcde", "é" * 9]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = quality._symbols(raw, offsets)
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        d = t.encode()
        want = [c + 256 * (len(d) - i >= 5 and any(d[i : i + 5] == d[i - k : i - k + 5] for k in range(1, 25) if i - k >= 0)) for i, c in enumerate(d)]
        assert got[a:b].tolist() == want


def test_quality_covers_whole_texts(spark):
    """Scores equal a plain network over every chunk, wherever the texts stand in a batch."""
    rng = np.random.default_rng(3)
    m = quality.Model(rng.normal(size=(quality.WIDTH, quality.SYMBOLS, quality.FILTERS)).astype(np.float32), rng.normal(size=quality.FILTERS), rng.normal(size=(quality.FILTERS, quality.HIDDEN)), rng.normal(size=quality.HIDDEN), rng.normal(size=2 * quality.HIDDEN) / 50, 0.1)
    texts = [None, "", "a", "x" * 255, "y" * 256, "z" * 257, "ab " * 400, "é" * 700, "".join(map(chr, rng.integers(32, 1000, 3000)))]

    def plain(text):
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        s = quality._symbols(raw, np.array([0, len(raw)]))
        n = max(1, -(-len(s) // quality.HALF))
        s = np.concatenate([s, np.zeros(n * quality.HALF - len(s) + quality.WIDTH, dtype=s.dtype)])
        value = lambda p: sum(m.tables[k][s[p + k]] if (p + k) // quality.HALF < n else m.tables[k][0] for k in range(quality.WIDTH))
        top = np.array([np.max([value(h * quality.HALF + p) for p in range(0, quality.HALF, quality.STRIDE)], axis=0) for h in range(n)])
        h = np.array([np.maximum(np.maximum(top[i : i + 2].max(axis=0) + m.bias, 0) @ m.hidden + m.hidden_bias, 0) for i in range(max(n - 1, 1))])
        z = np.concatenate([h.mean(axis=0), h.max(axis=0)]) @ m.out + m.out_bias
        return 1 / (1 + np.exp(-z))

    docs = spark.createDataFrame([(i, t, "c", "c") for i, t in enumerate(texts)], DOCS).coalesce(1)
    got = {r.doc_id: r.score for r in quality.score(docs, m).collect()}
    for i, t in enumerate(texts):
        assert abs(got[i] - plain(t)) < 1e-4


def test_quality_held_out(spark, sf):
    """The registered query on rows it has not learned from; junk is told from prose."""
    bigger = sf.replace("sf0.001", "sf0.01")
    got = queries.QUERIES["op12_quality"](spark, bigger).toPandas()
    docs = spark.read.parquet(f"{bigger}/documents.parquet")
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect()) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    labels = spark.read.parquet(f"{bigger}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    assert len(both) > 50 and (both[both.quality == 1].predicted == 1).mean() > 0.97
    ranks = both.score.rank()
    n1, n0 = (both.quality == 1).sum(), (both.quality == 0).sum()
    assert (ranks[both.quality == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.95


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", "c", "c"), (2, None, "c", "c"), (2, "", "c", "c")], DOCS)
    for rows, want in (([], 0.5), ([(1, 1, "x")], 0.75), ([(1, None, "x")], 0.5)):
        m = quality.fit(docs, spark.createDataFrame(rows, "doc_id long, quality int, text string"), F.col("doc_id") > 0)
        got = quality.score(docs, m).collect()
        assert len(got) == 3 and all(abs(r.score - want) < 1e-6 for r in got)
    assert quality.score(docs.limit(0), m).count() == 0
