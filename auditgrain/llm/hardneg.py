"""Hard negatives by length buckets and coordinate pruning.

Rows are sorted by (label, length, id) over Spark's range partitions and cut into buckets of at most ``BUCKET`` rows of one
label and near lengths.  A bucket keeps its vectors and, for every coordinate, the rows in the order of that coordinate
of the unit vectors.  Anchors are packed the same way and sent to shelves of buckets; a bucket whose longest vector
cannot reach an anchor's least useful score is passed over, and in the others the anchor's focus coordinates (its largest)
have feasible ranges, cut out of the sorted lists by binary search; what lies in all ranges is verified with exact products.
Where the ranges leave most of a bucket, it is verified whole.  The least useful score rises with the answers found.

Two searches: an anchor's best rows of its own label, then for each of them the best rows of other labels within a band of
its score.  Both return whole results; nothing is capped."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exact import matrix, pieces, products
from .scratch import partitions, written

SCALE = 256
#: Rows of a bucket, buckets of a shelf, anchors of a pack: bounds on what a task holds, without effect on the result.
BUCKET, SHELF, PACK = 1024, 16, 256
#: Focus coordinates of an anchor, and the share of a bucket from which ranges are not worth their intersection.
FOCUS, WORTH = 4, 0.5
_SLACK = 1e-9
_NONE = -(1 << 62)

_BUCKETS = "shelf long, top double, low double, label long, ids array<long>, vecs array<long>, orders array<int>"
_FOUND = "anchor_id long, rival_id long, positive_id long, positive_score long, score long"


def whole_vectors(embeddings: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x array<long>, squared) of the rows that take part: no null id or label, a vector of finite entries, of the most frequent length."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c * float(scale)).cast("long"))
    rows = embeddings.where(v.isNotNull() & (F.size(v) > 0) & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    return rows.withColumn("squared", F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Sorted rows cut into runs of one label and at most ``most`` rows; a row equal to the one before is dropped."""
    held: list[pa.RecordBatch] = []
    size, label, last = 0, None, None
    for batch in pieces(batches, most):
        labels = np.asarray(batch.column("label"))
        ids = batch.column("vec_id")
        keep = np.ones(batch.num_rows, dtype=bool)
        for i in np.flatnonzero(np.append(True, np.asarray(pc.equal(ids[1:], ids[:-1])))).tolist():
            before = batch.slice(i - 1, 1).to_pydict() if i else last
            keep[i] = before is None or before != batch.slice(i, 1).to_pydict()
        last = batch.slice(batch.num_rows - 1, 1).to_pydict()
        edges = np.flatnonzero(np.diff(labels)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
            part = batch.slice(start, end - start).filter(pa.array(keep[start:end]))
            if held and (labels[start] != label or size + part.num_rows > most):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            if part.num_rows:
                held.append(part)
                size, label = size + part.num_rows, labels[start]
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in the order of (label, falling length, id) within range partitions."""
    keys = [F.col("label"), F.col("squared").desc(), F.col("vec_id"), F.xxhash64("x")]
    return rows.repartitionByRange(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def build(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets of ``rows``, written, and a row (shelf, label, top) for each shelf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, filled, label = TaskContext.get().partitionId() << 32, 0, None
        for table in _runs(batches, BUCKET):
            ids, now = np.asarray(table.column("vec_id").combine_chunks()), table.column("label")[0].as_py()
            x = matrix(table.column("x").combine_chunks(), len(table.column("x")[0]))
            length = np.sqrt(np.asarray(table.column("squared")))
            unit = x / np.maximum(length, 1e-300)[:, None]
            if filled and (filled == SHELF or now != label):
                shelf, filled = shelf + 1, 0
            filled, label = filled + 1, now
            order = np.argsort(unit, axis=0, kind="stable").T.astype(np.int32)
            arrays = [pa.array([v]) for v in (shelf, float(length.max()), float(length.min()), now)]
            lists = [pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), pa.array(a.ravel())) for a in (ids, x, order)]
            yield pa.RecordBatch.from_arrays(arrays + lists, names=[c.split()[0] for c in _BUCKETS.split(", ")])

    buckets = written(_dealt(rows).mapInArrow(run, _BUCKETS), "buckets")
    return buckets, buckets.groupBy("shelf", "label").agg(F.max("top").alias("top"))


class _Anchors:
    """A pack of anchors while it passes a shelf: bands of useful scores and the answers so far."""

    def __init__(self, row: dict, keep: int):
        self.keep = keep
        self.label, self.ids = row["label"], np.array(row["ids"], dtype=np.int64)
        n = len(self.ids)
        self.x = np.array(row["vecs"], dtype=np.int64).reshape(n, -1)
        self.length = np.sqrt((self.x.astype(float) ** 2).sum(axis=1))
        self.unit = self.x / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]
        self.bands = [[(None, _NONE, None)] if own is None else [(b["id"], b["low"], b["high"]) for b in own] for own in row["bands"]]
        self.best: list[list[list[tuple[int, int]]]] = [[[] for _ in own] for own in self.bands]  # (-score, id), rising
        self.floor = [min((low for _, low, _ in own), default=None) for own in self.bands]

    def useful(self) -> np.ndarray:
        """The least score that can still enter an anchor's answers."""
        return np.array([math.inf if f is None else float(f) for f in self.floor])

    def take(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates of anchor ``i`` enter its answers."""
        low = []
        for b, (_, least, high) in enumerate(self.bands[i]):
            mine = self.best[i][b]
            least = max(least, -mine[-1][0]) if len(mine) == self.keep else least
            on = (scores >= least) & (ids != self.ids[i])
            if high is not None:
                on &= scores <= high
            s, w = scores[on], ids[on]
            if len(s):
                top = np.lexsort((w, -s))[: self.keep]
                mine = sorted({*mine, *zip((-s[top]).tolist(), w[top].tolist(), strict=True)})[: self.keep]
                self.best[i][b] = mine
            low.append(max(least, -mine[-1][0]) if len(mine) == self.keep else least)
        self.floor[i] = min(low, default=None)


class _Bucket:
    def __init__(self, row: dict):
        self.label, self.top, self.low = row["label"], row["top"], row["low"]
        self.ids = np.array(row["ids"], dtype=np.int64)
        n = len(self.ids)
        self.x = np.array(row["vecs"], dtype=np.int64).reshape(n, -1)
        self.order = np.array(row["orders"], dtype=np.int32).reshape(-1, n)
        unit = self.x / np.maximum(np.sqrt((self.x.astype(float) ** 2).sum(axis=1)), 1e-300)[:, None]
        self.sorted = np.take_along_axis(unit.T, self.order, axis=1)

    def ranges(self, a: _Anchors, mine: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor of ``mine`` and focus coordinate, the positions of the sorted list that can reach ``least``."""
        size = a.length[mine] * np.where(least > 0, self.top, self.low)
        cos = np.divide(least, size, out=np.full(len(mine), -1.0), where=size > 0)
        angle = np.arccos(np.clip(cos - _SLACK, -1, 1))[:, None]
        own = np.arccos(np.clip(np.take_along_axis(a.unit[mine], a.focus[mine], axis=1), -1, 1))
        lo, hi = np.cos(np.minimum(own + angle, np.pi)) - _SLACK, np.cos(np.maximum(own - angle, 0)) + _SLACK
        first, last = np.zeros(lo.shape, dtype=np.int64), np.full(lo.shape, len(self.ids), dtype=np.int64)
        for c in np.unique(a.focus[mine]):
            at = np.nonzero(a.focus[mine] == c)
            first[at] = np.searchsorted(self.sorted[c], lo[at])
            last[at] = np.searchsorted(self.sorted[c], hi[at], side="right")
        loose = cos <= -1  # no bound on the angle
        first[loose], last[loose] = 0, len(self.ids)
        return first, last

    def visit(self, a: _Anchors) -> None:
        least = a.useful()
        mine = np.flatnonzero(np.isfinite(least) & ((least <= 0) | (a.length * self.top * (1 + _SLACK) >= least)))
        if not len(mine):
            return
        first, last = self.ranges(a, mine, least[mine])
        width = last - first
        narrow = width.min(axis=1) < WORTH * len(self.ids)
        if (~narrow).any():
            whole = mine[~narrow]
            for i, scores in zip(whole.tolist(), products(a.x[whole], self.x), strict=True):
                a.take(i, self.ids, scores)
        for k in np.flatnonzero(narrow).tolist():
            i = int(mine[k])
            by = np.argsort(width[k], kind="stable")
            inside = np.zeros(len(self.ids), dtype=bool)
            got = self.order[a.focus[i, by[0]], first[k, by[0]] : last[k, by[0]]]
            for f in by[1:].tolist():
                if not len(got):
                    break
                inside[:] = False
                inside[self.order[a.focus[i, f], first[k, f] : last[k, f]]] = True
                got = got[inside[got]]
            if len(got):
                a.take(i, self.ids[got], products(a.x[i : i + 1], self.x[got])[0])


def _lists(batch: pa.RecordBatch, i: int) -> dict:
    """One row; lists of numbers as arrays, the bands as Python objects."""
    out = {}
    for name in batch.schema.names:
        value = batch.column(name)[i]
        if not value.is_valid:
            out[name] = None
        elif name in ("ids", "vecs", "orders"):
            out[name] = np.asarray(value.values)
        else:
            out[name] = value.as_py()
    return out


def _search(buckets: DataFrame, shelves: DataFrame, anchors: DataFrame, same_label: bool, keep: int) -> DataFrame:
    """(anchor_id, rival_id, positive_id, positive_score, score): for each anchor, band and shelf the best rows of the band.

    ``anchors`` has vec_id, label, x, squared and ``bands`` (array<struct<id, low, high>>; null: any score).  Packs go only to
    shelves that their longest anchor can use; buckets and packs are dealt by shelf, so a task holds a shelf and a pack at a time."""
    band = "array<struct<id: bigint, low: bigint, high: bigint>>"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for table in _runs(batches, PACK):
            ids, x, bands = (table.column(c).combine_chunks() for c in ("vec_id", "x", "bands"))
            lows = [_NONE if own is None else min((b["low"] for b in own), default=math.inf) for own in bands.to_pylist()]
            numbers = [pa.array([v]) for v in (number, table.column("label")[0].as_py(), math.sqrt(pc.max(table.column("squared")).as_py()), float(min(lows)))]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, pc.list_flatten(x), bands)]
            yield pa.RecordBatch.from_arrays(numbers + lists, names=["pack", "label", "size", "least", "ids", "vecs", "bands"])
            number += 1

    anchors = anchors.select("vec_id", "label", "x", "squared", F.col("bands").cast(band).alias("bands"))
    packs = written(_dealt(anchors).mapInArrow(pack, f"pack long, label long, size double, least double, ids array<long>, vecs array<long>, bands array<{band}>"), "packs")
    # which packs meet which shelves: a few numbers of each, met partition by partition of the buckets
    last = shelves.agg(F.max(F.shiftright("shelf", 32)).alias("last")).first()["last"]
    few = packs.select("pack", "label", "size", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))).alias("part"))
    there = shelves.select("shelf", F.col("label").alias("shelf_label"), "top", F.shiftright("shelf", 32).alias("part"))
    own = F.col("label") == F.col("shelf_label")
    reach = (F.col("least") <= 0) | (F.col("size") * F.col("top") * (1 + _SLACK) >= F.col("least"))
    pairs = few.join(there, "part").where((own if same_label else ~own) & reach).select("pack", "shelf")
    visits = packs.join(pairs, "pack").select("shelf", F.lit(1).alias("kind"), "label", "ids", "vecs", "bands")
    stock = buckets.select("shelf", F.lit(0).alias("kind"), "label", "ids", "vecs", "top", "low", "orders")
    dealt = stock.unionByName(visits, allowMissingColumns=True).repartition(max(partitions(packs.sparkSession), shelves.count()), "shelf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf, stock = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = _lists(batch, i)
                if row["shelf"] != shelf:
                    shelf, stock = row["shelf"], []
                if row["kind"] == 0:
                    stock.append(_Bucket(row))
                    continue
                a = _Anchors(row, keep)
                for bucket in stock:
                    if (bucket.label == a.label) == same_label:
                        bucket.visit(a)
                out = [(int(a.ids[k]), w, *b[::2], -s) for k, own in enumerate(a.bands) for b, best in zip(own, a.best[k], strict=True) for s, w in best]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return dealt.sortWithinPartitions("shelf", "kind", F.col("top").desc()).mapInArrow(run, _FOUND)


def hard_negatives(embeddings: DataFrame, anchor: Column, column: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` (on vec_id) says which rows are anchors.  Scores are inner products of floor(256 * c); higher ones come first, then
    the smaller vec_id.  An anchor's positives are its first other rows of the same label; a positive's negatives are
    the first rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows with a null id, label or vector, a null or non-finite entry, or a vector of another length than the most frequent one take no part; equal
    rows count once; vec_id must be unique among different rows.  Other columns are not read.  An empty table, an anchor without another row of
    its label, and a positive without a row in its band give no rows.  Scores must stay within a long."""
    rows = whole_vectors(embeddings, column)
    width = rows.groupBy(F.size("x").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    rows = rows.where(F.size("x") == (width[0]["w"] if width else 0))
    buckets, shelves = build(rows)
    anchors = rows.where(anchor)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "rival_id")
    found = _search(buckets, shelves, anchors.withColumn("bands", F.lit(None)), True, positives)
    best = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives)
    bound = lambda share, up: F.expr(f"(score * {share} + {up}) div 100")  # noqa: E731  scores below 0 have no band
    bands = best.where("score >= 0").groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("rival_id").alias("id"), bound(low, 99).alias("low"), bound(high, 0).alias("high"), "score")).alias("found"))
    bands = written(bands, "positives")
    scores = bands.select("anchor_id", F.explode("found").alias("f")).select("anchor_id", F.col("f.id").alias("positive_id"), F.col("f.score").alias("positive_score"))
    again = anchors.join(bands.select(F.col("anchor_id").alias("vec_id"), F.transform("found", lambda f: F.struct(f["id"].alias("id"), f["low"].alias("low"), f["high"].alias("high"))).alias("bands")), "vec_id")
    rivals = _search(buckets, shelves, again, False, negatives).drop("positive_score")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "rival_id")
    ranked = rivals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.join(scores, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", F.col("rival_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The registered query in DuckDB SQL: relabelled rows, anchors against all rows.
ORACLE_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5"""
