"""Exact removal of repeated byte strings with suffix arrays.

A byte goes when a string of ``length`` bytes that covers it also starts earlier in the corpus.

1.  Anchors: in every window of ``length`` bytes the least hash of its ``gram``-byte strings is an anchor, so two equal
    windows have equal anchors.  Anchors of one occurrence are dropped (one aggregation, one join).
2.  An anchor's *context* is all that windows with this anchor can cover.  Among occurrences with equal
    contexts all but the first are covered whole.
3.  Only the first of each context of an anchor with several contexts needs its bytes: they are dealt
    into shards by anchor; each shard sorts its suffixes by Larsson-Sadakane refinement, gets
    the common prefixes of neighbours by Kasai's walk, and marks every window that also starts earlier.
4.  An anchor of more than ``SHARD`` contexts is halved by how far its windows reach to the left: all windows
    of a half share more bytes around the anchor, which make a longer key.  Contexts alone with
    their key leave; the others go on, in two rows at most, until a key fits a shard or its windows are ``NARROW``.
5.  A narrow key that is still too large is split over several shards; their sorted runs of
    distinct windows are merged by binary search, comparing bytes.
6.  Covered ranges go back to their documents, are merged and cut out.

Hashes (64 bits of a context within its anchor, 128 bits and the size of whole copies) stand for bytes in steps 1 and 2."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import Poly, grouped, slices, text_buffer
from .scratch import partitions, written

LENGTH = 100
GRAM = 60
SHARD = 2_048
#: So many windows a context, at most, are compared across the shards of one key.
NARROW = 6
#: Bytes of text that a task works on at once: hashes and their scratch take about sixty times as much.
SLICE = 2 << 20
#: Up to so many ids (16 MB) a list of documents is broadcast; a longer one is joined by shuffling.
BROADCAST_IDS = 2_000_000


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every ``width`` neighbours, by doubling; entry i covers i .. i + width - 1."""
    have, out = 1, x
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    return op(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the buffer, hash, row) of the anchors of all texts."""
    none = np.zeros(0, dtype=np.int64)
    hashes = Poly(raw).grams(gram)
    width = length - gram + 1
    if len(hashes) < width:
        return none, none.astype(np.uint64), none
    g = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # 32 bits choose; a tie makes one more anchor
    low = _slide(g, width, np.minimum)  # for every window start
    valid = np.zeros(len(low) + 1, dtype=np.int64)
    long_ = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(valid, offsets[long_], 1)
    np.add.at(valid, offsets[long_ + 1] - length + 1, -1)
    low[np.cumsum(valid)[:-1] == 0] = 0
    edge = np.zeros(width - 1, dtype=np.uint32)
    best = _slide(np.concatenate([edge, low, edge]), width, np.maximum)[: len(g)]
    at = np.flatnonzero(best == g)
    return at, hashes[at], np.searchsorted(offsets, at, side="right") - 1


def suffix_array(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffixes of the strings ``raw[starts:ends]`` (side by side), sorted by their first ``depth`` bytes (all without it).

    Larsson and Sadakane: groups of equal prefixes are refined by the rank of what follows, the depth
    doubling each time; groups of one leave the work."""
    n = len(raw)
    depth = min(int((ends - starts).max(initial=0)), depth or len(raw))
    stop = np.repeat(ends, ends - starts).astype(np.int32)
    place = np.arange(n, dtype=np.int32)
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        at = place + np.int32(k)
        key <<= 9
        key |= np.where(at < stop, raw[np.minimum(at, n - 1)].astype(np.int16) + 1, 0)
    sa = np.argsort(key).astype(np.int32)
    sorted_ = key[sa]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    del key, sorted_
    rank = np.empty(n, dtype=np.int32)
    rank[sa] = np.maximum.accumulate(np.where(fresh, place, 0))
    h = 7
    while h < depth:
        alone = fresh & np.append(fresh[1:], True)
        todo = np.flatnonzero(~alone)
        if not len(todo):
            break
        sub = sa[todo]
        nxt = sub + np.int32(h)
        follow = np.where(nxt < stop[sub], rank[np.minimum(nxt, n - 1)] + 1, 0)
        head = rank[sub]
        order = np.argsort(head.astype(np.int64) * (n + 2) + follow)
        sub, follow, head = sub[order], follow[order], head[order]
        sa[todo] = sub
        change = np.ones(len(sub), dtype=bool)
        change[1:] = (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])
        fresh[todo] = change
        rank[sub] = np.maximum.accumulate(np.where(change, todo, 0))
        h *= 2
    return sa


def common_prefixes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, up to ``cap``; ``sa`` may leave suffixes out.

    Kasai's walk, in all strings at once: a suffix's prefix is at most one byte shorter than that of the
    suffix before it in the text, if the next suffixes of both stand in ``sa`` in the same order.  Bytes are compared eight at a time."""
    n = len(raw)
    rank = np.full(n + 1, -1, dtype=np.int32)  # -1: not in sa
    rank[sa] = np.arange(len(sa), dtype=np.int32)
    stop = np.repeat(ends, ends - starts).astype(np.int32)
    eight = np.ascontiguousarray(np.ndarray(n, dtype="<u8", buffer=np.concatenate([raw, np.zeros(8, dtype=np.uint8)]), strides=(1,)))
    out = np.zeros(n, dtype=np.int32)
    h = np.zeros(len(starts), dtype=np.int32)
    starts, ends = starts.astype(np.int32), ends.astype(np.int32)
    for t in range(int((ends - starts).max(initial=0))):
        live = np.flatnonzero(starts + t < ends)
        live = live[rank[starts[live] + t] > 0]
        i = starts[live] + t
        j = sa[rank[i] - 1]
        room = np.minimum(np.minimum(stop[i] - i, stop[j] - j), cap)
        cur = h[live]
        go = np.flatnonzero(cur < room)
        while len(go):
            at = cur[go]
            x = eight[i[go] + at] ^ eight[j[go] + at]
            same = x == 0
            lowest = x & (~x + np.uint64(1))
            cur[go] = at + np.where(same, 8, np.log2(np.where(same, 1, lowest).astype(np.float64)).astype(np.int32) >> 3)
            go = go[same]
            go = go[cur[go] < room[go]]
        cur = np.minimum(cur, room)
        out[i] = cur
        h[:] = 0
        follow = rank[j + 1]  # where j ends its string cur is 1 at most
        h[live] = np.where((follow >= 0) & (follow < rank[np.minimum(i + 1, n)]), np.maximum(cur - 1, 0), 0)
    return out[sa]


def _shard(table: pa.Table, length: int) -> tuple[np.ndarray, ...]:
    """Windows of a shard in sorted order: (class number, doc, start, place in the buffer), and the buffer."""
    raw, offsets = text_buffer(table.column("bytes"))
    starts, ends = offsets[:-1], offsets[1:]
    sa = suffix_array(raw, starts, ends, length)
    owner = np.repeat(np.arange(len(starts)), ends - starts)[sa]
    whole = ends[owner] - sa >= length
    sa, owner = sa[whole], owner[whole]
    cls = np.cumsum(common_prefixes(raw, starts, ends, sa, length) < length)
    doc = np.asarray(table.column("doc_id"))[owner]
    start = np.asarray(table.column("start"))[owner] + sa - starts[owner]
    return cls, doc, start, sa, raw


def _first(cls: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (class, doc, start), and in that order whether the window is not its class's first place."""
    order = np.lexsort((start, doc, cls))
    c, d, s = cls[order], doc[order], start[order]
    begin = np.ones(len(c), dtype=bool)
    begin[1:] = c[1:] != c[:-1]
    head = np.maximum.accumulate(np.where(begin, np.arange(len(c)), 0))
    return order, (d != d[head]) | (s != s[head])


def _ranges(doc: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Covered ranges of windows, neighbours joined."""
    order = np.lexsort((start, doc))
    d, s = doc[order], start[order]
    cut = np.ones(len(d), dtype=bool)
    cut[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + length)
    at = np.flatnonzero(cut)
    last = np.append(at[1:], len(d)) - 1 if len(d) else at
    return pa.RecordBatch.from_arrays([pa.array(d[at], pa.int64()), pa.array(s[at], pa.int64()), pa.array(s[last] + length, pa.int64())], names=["doc_id", "start", "end"])


_RANGE = "doc_id long, start long, end long"


def _ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """docs joined with a list of ids; it is broadcast only when it is counted to be short."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def _contexts(docs: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Steps 1 and 2.  (ranges of occurrences whose whole context came earlier; contexts to search: fp, k contexts of this anchor, doc_id, start, at, size)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # bits that leave one chance hit in 256; a chance hit costs time only
    shift = max(0, 64 - 8 - max(int(total) * 2 // (length - gram + 2), 1).bit_length())

    def scan(full: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, limit=SLICE):
                raw, offsets = text_buffer(part.column("text"))
                at, g, row = anchors(raw, offsets, length, gram)
                fp = pa.array((g >> np.uint64(shift)).view(np.int64))
                if not full:
                    yield pa.RecordBatch.from_arrays([fp], names=["fp"])
                    continue
                lo = np.maximum(offsets[row], at - (length - gram))
                hi = np.minimum(offsets[row + 1], at + length)
                ctx = Poly(raw).ranges(lo, hi) + (at - lo).astype(np.uint64)
                doc = part.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays([fp, pa.array(ctx.view(np.int64)), doc, pa.array(lo - offsets[row], pa.int32()), pa.array(at - lo, pa.int16()), pa.array(hi - lo, pa.int16())], names=["fp", "ctx", "doc_id", "start", "at", "size"])

        return run

    # Each list of keys is written first: a join of two plain exchanges is one whose hot keys Spark can split.
    met = written(docs.mapInArrow(scan(False), "fp long").groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp"), "met")
    seen = written(docs.mapInArrow(scan(True), "fp long, ctx long, doc_id long, start int, at smallint, size smallint").join(met, "fp"), "anchors")
    place = F.struct("doc_id", "start")
    classes = written(seen.groupBy("fp", "ctx").agg(F.min(F.struct("doc_id", "start", "at", "size")).alias("first"), F.count(F.lit(1)).alias("n")), "contexts")
    again = (
        seen.join(written(classes.where("n > 1").select("fp", "ctx", F.struct("first.doc_id", "first.start").alias("first")), "again"), ["fp", "ctx"])
        .where(place > F.col("first")).select("doc_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("size")).cast("long").alias("end"))
    )
    many = written(classes.groupBy("fp").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "many")
    return again, classes.join(many, "fp").select("fp", "k", "first.*")


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each context listed in ``cut`` of a text."""
    for part in slices(batches, limit=SLICE):
        raw, offsets = text_buffer(part.column("text"))
        lists = part.column("cut")
        flat = lists.flatten()
        row = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths()))
        start, size = np.asarray(flat.field("start")).astype(np.int64), np.asarray(flat.field("size")).astype(np.int64)
        for a in range(0, len(row), 50_000):
            r, s, z = row[a : a + 50_000], start[a : a + 50_000], size[a : a + 50_000]
            begin = offsets[r] + s
            out = np.zeros(len(r) + 1, dtype=np.int32)
            np.cumsum(z, out=out[1:])
            at = np.arange(int(out[-1])) - np.repeat(out[:-1], z) + np.repeat(begin, z)
            data = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(out), pa.py_buffer(np.ascontiguousarray(raw[at]))])
            k = flat.slice(a, 50_000)
            yield pa.RecordBatch.from_arrays([k.field("fp"), k.field("k"), k.field("at"), part.column("doc_id").take(pa.array(r)), pa.array(s, pa.int64()), data], names=["fp", "k", "at", "doc_id", "start", "bytes"])


def _search(contexts: DataFrame, n_rows: int, length: int, shard: int) -> DataFrame:
    """Step 3 for contexts (key, doc_id, start, bytes) whose keys fit a shard: later places of every window that several of them have."""
    n_parts, n_shards = partitions(contexts.sparkSession), max(1, -(-n_rows // shard))
    dealt = contexts.select(F.pmod(F.xxhash64("key"), F.lit(n_shards)).alias("shard"), "doc_id", "start", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["shard"]):
            cls, doc, start, *_ = _shard(g, length)
            order, later = _first(cls, doc, start)
            yield _ranges(doc[order][later], start[order][later], length)

    return dealt.repartition(n_parts, "shard").sortWithinPartitions("shard").mapInArrow(run, _RANGE)


def _halves(wide: DataFrame, length: int, gram: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """Step 4: (contexts with a key that fits a shard, contexts of larger keys with narrow windows), of ``wide`` (doc_id, start, at, bytes).

    A row stands for the windows that begin lo to hi bytes left of its anchor; its key are the bytes that these
    windows share.  As many rounds as ``length - gram`` can be halved, whatever the number of rows."""
    room = length - gram
    cur = wide.select("doc_id", "start", "at", "bytes", F.lit(0).alias("lo"), F.lit(room).alias("hi"))
    fit, narrow = [], []
    width = room + 1
    while True:
        half = F.expr("(lo + hi) div 2").cast("int")
        cut = F.array(F.struct(F.col("lo"), half.alias("hi")), F.struct((half + 1).alias("lo"), F.col("hi")))
        rows = (
            cur.select("doc_id", "start", "at", "bytes", F.inline(cut))
            .where(f"lo <= hi and at >= lo and octet_length(bytes) - at - {gram} >= {room} - hi")
            .withColumn("key", F.xxhash64("lo", F.expr(f"substring(bytes, at - lo + 1, lo + {gram} + {room} - hi)")))
        )
        rows = written(rows, "halves")
        sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "sizes")
        rows = rows.join(sizes, "key")
        fit.append(rows.where(F.col("k") <= shard).select("key", "doc_id", "start", "bytes"))
        width = -(-width // 2)
        cur = rows.where(F.col("k") > shard)
        if width <= NARROW:
            narrow.append(cur)
            break
        cur = written(cur, "larger")
        if cur.isEmpty():
            break
    small = fit[0]
    for x in fit[1:]:
        small = small.unionByName(x)
    return small, narrow[0] if narrow else None


def _fixed(column: pa.ChunkedArray, length: int) -> np.ndarray:
    """Strings of ``length`` bytes for numpy to compare; a byte at the end keeps zero bytes before it."""
    raw, offsets = text_buffer(column)
    out = np.ones((len(offsets) - 1, length + 1), dtype=np.uint8)
    out[:, :length] = raw.reshape(-1, length)
    return out.view(f"S{length + 1}")[:, 0]


def _merge_two(a: tuple, b: tuple) -> tuple[tuple, tuple]:
    """Two sorted runs (window, doc, start) as one, and the later place of each window that both have."""
    (w, d, s), (v, e, t) = a, b
    at = np.searchsorted(w, v)
    hit = np.zeros(len(v), dtype=bool)
    inside = at < len(w)
    hit[inside] = w[at[inside]] == v[inside]
    i = at[hit]
    swap = (e[hit] < d[i]) | ((e[hit] == d[i]) & (t[hit] < s[i]))
    later = np.where(swap, d[i], e[hit]), np.where(swap, s[i], t[hit])
    other = (later[0] != np.where(swap, e[hit], d[i])) | (later[1] != np.where(swap, t[hit], s[i]))
    d[i], s[i] = np.where(swap, e[hit], d[i]), np.where(swap, t[hit], s[i])
    at = at[~hit]
    return tuple(np.insert(x, at, y[~hit]) for x, y in ((w, v), (d, e), (s, t))), (later[0][other], later[1][other])


def _merge(contexts: DataFrame, length: int, shard: int) -> DataFrame:
    """Step 5 for contexts (key, k, lo, hi, at, doc_id, start, bytes): ranges of later places.

    Each shard of a key gives its distinct windows as a sorted run; the runs, dealt out by a hash of the
    window, are merged two by two."""
    n_parts = partitions(contexts.sparkSession)
    salt = F.pmod(F.xxhash64("doc_id", "start"), F.expr(f"(k + {shard - 1}) div {shard}")).cast("int")
    dealt = contexts.select("key", salt.alias("salt"), "lo", "hi", "at", "doc_id", "start", "bytes").repartition(n_parts, "key", "salt").sortWithinPartitions("key", "salt")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of a shard's own later places (no window), and its distinct windows of lo to hi with their first places."""
        for g in grouped(batches, ["key", "salt"]):
            cls, doc, start, sa, raw = _shard(g, length)
            order, later = _first(cls, doc, start)
            own = _ranges(doc[order][later], start[order][later], length)
            none = pa.nulls(own.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *own.columns, pa.nulls(own.num_rows, pa.binary())], names=["h", "run", "doc_id", "start", "end", "bytes"])
            order = order[~later]
            order = order[np.unique(cls[order], return_index=True)[1]]  # one place a class, in sorted order
            ends = np.cumsum(np.diff(text_buffer(g.column("bytes"))[1]))
            owner = np.searchsorted(ends, sa[order], side="right")
            left = np.asarray(g.column("at"))[owner] - (sa[order] - np.concatenate([[0], ends])[owner])
            fits = (left >= np.asarray(g.column("lo"))[owner]) & (left <= np.asarray(g.column("hi"))[owner])
            order = order[fits]
            for a in range(0, len(order), 20_000):
                o = order[a : a + 20_000]
                data = np.ascontiguousarray(raw[sa[o][:, None] + np.arange(length)])
                offsets = np.arange(len(o) + 1, dtype=np.int32) * np.int32(length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(Poly(raw).ranges(sa[o], sa[o] + length).view(np.int64)), pa.array(np.full(len(o), g.column("key")[0].as_py() ^ g.column("salt")[0].as_py())), pa.array(doc[o], pa.int64()), pa.array(start[o], pa.int64()),
                     pa.nulls(len(o), pa.int64()), pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(offsets), pa.py_buffer(data)])],
                    names=["h", "run", "doc_id", "start", "end", "bytes"],
                )

    found = written(dealt.mapInArrow(runs, "h long, run long, doc_id long, start long, end long, bytes binary"), "runs")
    windows = found.where("h is not null")
    n = max(n_parts, windows.count() // 50_000)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches, ["part"]):
            run = np.asarray(g.column("run"))
            cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(run)]
            cols = _fixed(g.column("bytes"), length), np.asarray(g.column("doc_id")), np.asarray(g.column("start"))
            work = [tuple(c[a:b].copy() for c in cols) for a, b in zip(cuts, cuts[1:], strict=False)]
            while len(work) > 1:
                pairs = [_merge_two(a, b) for a, b in zip(work[::2], work[1::2], strict=False)]
                yield _ranges(np.concatenate([p[1][0] for p in pairs]), np.concatenate([p[1][1] for p in pairs]), length)
                work = [p[0] for p in pairs] + work[len(pairs) * 2 :]

    merged = windows.select(F.pmod("h", F.lit(n)).alias("part"), "run", "bytes", "doc_id", "start").repartition(n_parts, "part").sortWithinPartitions("part", "run", "bytes")
    return found.where("h is null").select("doc_id", "start", "end").unionByName(merged.mapInArrow(merge, _RANGE))


def covered_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(doc_id, spans array<struct<start, end>>): byte ranges of ``docs`` (doc_id, text) that start earlier elsewhere, not merged.

    Places are ordered by doc_id, then by byte.  Texts under ``length`` bytes, and rows whose doc_id is null,
    have none; doc_id must be unique among different texts."""
    docs = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Whole copies first: all of a later one is covered, and it need not be searched.
    same = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), "text").alias("b"), F.octet_length("text").alias("size")]
    whole = docs.select("doc_id", *same)
    firsts = written(whole.groupBy("a", "b", "size").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copied")
    copies = written(whole.join(firsts, ["a", "b", "size"]).where("doc_id > first").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("end")), "copies")
    docs = _ids(docs, copies.select("doc_id"), "left_anti")
    again, heads = _contexts(docs, length, gram)
    wanted = written(heads.groupBy("doc_id").agg(F.collect_list(F.struct("fp", "k", "at", "start", "size")).alias("cut")), "cuts")
    n_rows, widest = wanted.select(F.explode("cut.k").alias("k")).agg(F.count(F.lit(1)), F.coalesce(F.max("k"), F.lit(0))).first()
    context = (
        _ids(docs, wanted.select("doc_id"), "left_semi").join(wanted, "doc_id").select("doc_id", "text", "cut")
        .mapInArrow(_cut_out, "fp long, k long, at short, doc_id long, start long, bytes binary")
    )
    small = context.where(F.col("k") <= shard).select(F.col("fp").alias("key"), "doc_id", "start", "bytes")
    found = again.unionByName(copies)
    if widest > shard:
        context = written(context, "context")
        small = context.where(F.col("k") <= shard).select(F.col("fp").alias("key"), "doc_id", "start", "bytes")
        halves, narrow = _halves(context.where(F.col("k") > shard), length, gram, shard)
        small = small.unionByName(halves)
        if narrow is not None:
            found = found.unionByName(_merge(narrow, length, shard))
    found = found.unionByName(_search(small, int(n_rows), length, shard))
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def drop_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for every row of ``docs`` (doc_id, text).

    kept are the bytes that stay, one after the other; n_spans counts maximal removed runs.  A null text is empty.
    See covered_ranges for what is removed; other columns are not read."""
    spans = written(covered_ranges(docs, length, gram, shard), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            raw, offsets = text_buffer(part.column("text"))
            lists = part.column("spans")
            flat = lists.flatten()
            counts = np.asarray(lists.value_lengths().fill_null(0))
            row = np.repeat(np.arange(part.num_rows), counts)
            depth = np.zeros(len(raw) + 1, dtype=np.int64)
            size = np.diff(offsets)
            np.add.at(depth, offsets[row] + np.minimum(np.asarray(flat.field("start")).astype(np.int64), size[row]), 1)
            np.add.at(depth, offsets[row] + np.minimum(np.asarray(flat.field("end")).astype(np.int64), size[row]), -1)
            gone = np.cumsum(depth)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[offsets[1:]] - total[offsets[:-1]]
            begin = gone.copy()
            if len(gone):
                first = np.zeros(len(gone) + 1, dtype=bool)
                first[offsets] = True
                begin[1:] &= ~gone[:-1] | first[1 : len(gone)]
            runs = np.concatenate([[0], np.cumsum(begin)])
            data = raw[~gone]
            out = np.zeros(part.num_rows + 1, dtype=np.int32)
            np.cumsum(size - removed, out=out[1:])
            kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(out), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs[offsets[1:]] - runs[offsets[:-1]], pa.int64()), kept], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = spans.select("doc_id")
    none = F.lit(None).cast("array<struct<start: bigint, end: bigint>>").alias("spans")
    if ids.count() <= BROADCAST_IDS:  # most texts keep all; only the others are shuffled
        touched = base.join(F.broadcast(ids), "doc_id", "left_semi").join(spans, "doc_id")
        rows = base.join(F.broadcast(ids), "doc_id", "left_anti").select("doc_id", "text", none).unionByName(touched)
    else:
        rows = base.join(spans, "doc_id", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
