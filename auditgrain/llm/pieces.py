"""SentencePiece encoding and decoding by max-plus (best path) search over a public vocabulary.

The vocabulary's pieces and scores are read from a model file given by path; the segmentation is the
one of highest total score, which is what SentencePiece's unigram mode gives for the same pieces and
scores.  A file fitted as BPE holds merge ranks instead of log-probabilities (whole numbers that fall);
its pieces get Zipf's log-probability of their rank, so ids are those of the best path over that
vocabulary, not those of BPE merging.
Characters without a piece become byte tokens.  A space is put before every non-empty text, as the
model's normaliser does, so encoding and decoding are inverse for every text.

No piece has a space after another character, so a space after another byte is a place that no
piece crosses (and so is a byte that no piece holds): texts are cut there into units, and each distinct unit of a
slice is segmented once, all at the same time.

A text of more than ``giant_bytes`` is cut into chunks that Spark deals out:

1. each chunk gives a transfer matrix M[i, j]: the best score from "a piece of the chunk before
   reaches i bytes into this one" to "a piece of this one reaches j bytes into the next";
2. matrices are combined associatively in blocks of 32, level by level, up to one per text;
3. the best states are handed down the same tree;
4. each chunk is backtraced on its own between its two states.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import Poly, grouped, list_array, slices, spread, text_buffer
from .scratch import checkpointed, partitions, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
GIANT_BYTES = 64 << 10
CHUNK_BYTES = 32 << 10
FAN = 32
NEG = -np.inf
_UNIT = 48
_CHAR = np.ones(256, dtype=np.int64)
_CHAR[0xC0:0xE0], _CHAR[0xE0:0xF0], _CHAR[0xF0:0xF8] = 2, 3, 4


class Vocabulary(NamedTuple):
    """Plain data of a model, small and of fixed size: what tasks get."""

    pieces: tuple[bytes, ...]  # what each id stands for, U+2581 as a space
    scores: tuple[float, ...]
    normal: tuple[bool, ...]  # takes part in the search
    byte_ids: tuple[int, ...]


@lru_cache(maxsize=4)
def load_vocabulary(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    with open(path, "rb") as f:
        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    pieces, normal, byte_ids = [], [], [-1] * 256
    for i in range(sp.get_piece_size()):
        text = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(text[3:5], 16)] = i
            pieces.append(bytes([int(text[3:5], 16)]))
        else:
            pieces.append(b"" if sp.is_control(i) or sp.is_unknown(i) else text.replace("▁", " ").encode())
        normal.append(not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))
    if min(byte_ids) < 0:
        raise ValueError(f"{path} has no byte tokens")
    scores = [sp.get_score(i) for i in range(len(pieces))]
    if all(s == int(s) for s, use in zip(scores, normal, strict=True) if use):  # ranks
        rank = np.cumsum(normal)
        total = np.log((1.0 / np.arange(1, rank[-1] + 1)).sum())
        scores = [float(np.float32(-np.log(r) - total)) if use else 0.0 for r, use in zip(rank.tolist(), normal, strict=True)]
    return Vocabulary(tuple(pieces), tuple(scores), tuple(normal), tuple(byte_ids))


class Lattice:
    """Prefix tree of the pieces as arrays, and best-path search over it."""

    def __init__(self, v: Vocabulary):
        children: list[dict[int, int]] = [{}]
        piece_at = [-1]
        for i, (p, use) in enumerate(zip(v.pieces, v.normal, strict=True)):
            if not use:
                continue
            node = 0
            for b in p:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    piece_at.append(-1)
                node = nxt
            piece_at[node] = i
        inner = [n for n, c in enumerate(children) if c]
        number = {n: k for k, n in enumerate(inner)}
        for n, c in enumerate(children):
            if not c:
                number[n] = len(number)
        self.inner = len(inner)
        self.trans = np.full((self.inner, 256), -1, dtype=np.int32)
        for k, n in enumerate(inner):
            for b, c in children[n].items():
                self.trans[k, b] = number[c]
        self.piece = np.full(len(children), -1, dtype=np.int32)
        for n, k in number.items():
            self.piece[k] = piece_at[n]
        self.score = np.array(v.scores)
        used = [p for p, use in zip(v.pieces, v.normal, strict=True) if use]
        # Ten below the least score, as the library has it, but for pieces that a model rules out by a huge penalty.
        self.unknown = min((x for x, use in zip(v.scores, v.normal, strict=True) if use and x > -1e8), default=0.0) - 10.0
        self.reach = max(map(len, used))
        self.byte_ids = np.array(v.byte_ids, dtype=np.int32)
        seen = np.zeros(256, dtype=bool)
        for p in used:
            seen[list(p)] = True
        self.alone = ~seen & (np.arange(256) < 128)  # bytes that stand in no piece
        self.cut_at_space = not any(b" " in p.lstrip(b" ") for p in used)
        self.memo: dict[bytes, tuple[list[int], float]] = {}

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the units of all texts."""
        at = np.zeros(len(raw), dtype=bool)
        if len(raw):
            if self.cut_at_space:
                space = raw == 0x20
                at[1:] = space[1:] & ~space[:-1]
            lone = self.alone[raw]
            at |= lone
            at[1:] |= lone[:-1]
            at[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(at)

    def one(self, data: bytes, entry: int = 0, stop: int | None = None) -> tuple[list[int], float]:
        """Best path from byte ``entry`` to byte ``stop``, for a single run of bytes."""
        n = len(data) if stop is None else stop
        best, back, pid = [NEG] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[entry] = 0.0
        for t in range(entry, n):
            if best[t] == NEG:
                continue
            for end, p, s in self.steps(data, t):
                if end <= n and best[t] + s > best[end]:
                    best[end], back[end], pid[end] = best[t] + s, t, p
        ids: list[int] = []
        t = n
        while t > entry:
            ids += [pid[t]] if pid[t] >= 0 else [int(self.byte_ids[b]) for b in reversed(data[back[t] : t])]
            t = back[t]
        return ids[::-1], best[n]

    def steps(self, data: bytes, t: int) -> list[tuple[int, int, float]]:
        """(end, piece, score) of the pieces that start at byte ``t``."""
        node, out, single = 0, [], t + int(_CHAR[data[t]])
        known = False
        for d in range(t, len(data)):
            node = int(self.trans[node, data[d]])
            if node < 0:
                break
            if (p := int(self.piece[node])) >= 0:
                out.append((d + 1, p, float(self.score[p])))
                known |= d + 1 == single
            if node >= self.inner:
                break
        if not known:
            out.append((min(single, len(data)), -1, self.unknown))
        return out

    def many(self, raw: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best paths of all units at once: (ids one unit after the other, ids per unit, score per unit)."""
        n = len(starts)
        count, score = np.zeros(n, dtype=np.int64), np.zeros(n)
        unit_of, place, ids = [], [], []
        big = np.flatnonzero(lens > _UNIT)
        for u in big:
            data = raw[starts[u] : starts[u] + lens[u]].tobytes()
            got, score[u] = self.one(data)
            count[u] = len(got)
            unit_of.append(np.full(len(got), u))
            place.append(np.arange(len(got)))
            ids.append(np.array(got, dtype=np.int32))
        for low, high in ((0, 8), (8, 16), (16, _UNIT)):
            pick = np.flatnonzero((lens > low) & (lens <= high))
            if len(pick):
                pick = pick[np.argsort(-lens[pick], kind="stable")]
                u, at, got, score[pick] = self._matrix(raw, starts[pick], lens[pick], high)
                unit_of.append(pick[u])
                place.append(at)
                ids.append(got)
        if not ids:
            return np.zeros(0, dtype=np.int32), count, score
        unit, at, got = np.concatenate(unit_of), np.concatenate(place), np.concatenate(ids)
        return got[np.lexsort((at, unit))], np.bincount(unit, minlength=n), score

    def _matrix(self, raw, starts, lens, width):
        n = len(starts)
        cols = np.arange(width)[:, None]
        text = np.where(cols < lens, raw[np.minimum(starts + cols, len(raw) - 1)], 0).astype(np.uint8)
        best = np.full((width + 1, n), NEG)
        best[0] = 0
        back = np.zeros((width + 1, n), dtype=np.int8)
        pid = np.full((width + 1, n), -1, dtype=np.int32)
        for t in range(width):
            k = int(np.searchsorted(-lens, -t))  # lens fall, so the first k are longer than t
            idx = np.flatnonzero(best[t, :k] > NEG)
            if not len(idx):
                continue
            begun, base, node = idx, best[t, idx], np.zeros(len(idx), dtype=np.int32)
            single = t + _CHAR[text[t, idx]]
            known = np.zeros(n, dtype=bool)
            for d in range(t, width):
                node = self.trans[node, text[d, idx]]
                on = node >= 0
                idx, node, base, single = idx[on], node[on], base[on], single[on]
                if not len(idx):
                    break
                p = self.piece[node]
                has = p >= 0
                i, q = idx[has], p[has]
                s = base[has] + self.score[q]
                known[i[single[has] == d + 1]] = True
                up = s > best[d + 1, i]
                i = i[up]
                best[d + 1, i], back[d + 1, i], pid[d + 1, i] = s[up], t, q[up]
                on = node < self.inner
                idx, node, base, single = idx[on], node[on], base[on], single[on]
                if not len(idx):
                    break
            lost = begun[~known[begun]]
            if len(lost):
                end = np.minimum(t + _CHAR[text[t, lost]], lens[lost])
                s = best[t, lost] + self.unknown
                up = s > best[end, lost]
                best[end[up], lost[up]], back[end[up], lost[up]], pid[end[up], lost[up]] = s[up], t, -1
        rows = np.arange(n)
        total = best[lens, rows]
        pos, u = lens.copy(), rows
        us, sts, ens, ps = [], [], [], []
        while len(u):
            st = back[pos, u].astype(np.int64)
            us.append(u), sts.append(st), ens.append(pos), ps.append(pid[pos, u])
            on = st > 0
            u, pos = u[on], st[on]
        u, st, en, p = map(np.concatenate, (us, sts, ens, ps))
        cnt = np.where(p < 0, en - st, 1)
        u2, st2, p2 = np.repeat(u, cnt), np.repeat(st, cnt), np.repeat(p, cnt)
        st2 = st2 + np.arange(len(u2)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
        return u2, st2, np.where(p2 < 0, self.byte_ids[text[np.minimum(st2, width - 1), u2]], p2).astype(np.int32), total

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts one after the other, ids per text, score per text (spaces put in front already)."""
        rows = len(offsets) - 1
        starts = self.cuts(raw, offsets)
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(rows, dtype=np.int64), np.zeros(rows)
        lens = np.diff(np.append(starts, len(raw)))
        _, first, which = np.unique(Poly(raw).ranges(starts, starts + lens), return_index=True, return_inverse=True)
        ids, count, score = self.many(raw, starts[first], lens[first])
        begin = np.cumsum(count) - count
        row = np.searchsorted(offsets, starts, side="right") - 1
        per_unit = count[which]
        return (spread(ids, begin[which], per_unit), np.bincount(row, weights=per_unit, minlength=rows).astype(np.int64), np.bincount(row, weights=score[which], minlength=rows))

    # -- chunks of giant texts -------------------------------------------------------------

    def _head_and_tail(self, body: bytes) -> tuple[int, int]:
        """First and last place in ``body`` that no piece crosses (-1, -1: none)."""
        raw = np.frombuffer(body, dtype=np.uint8)
        at = self.cuts(raw, np.array([0, len(raw)]))
        at = at[at > 0]
        return (int(at[0]), int(at[-1])) if len(at) else (-1, -1)

    def _dense(self, data: bytes, stop: int, entries: int) -> np.ndarray:
        """best[i, e]: from byte i (< entries) to byte e; pieces start before ``stop``."""
        best = np.full((len(data) + 1, entries), NEG)
        best[np.arange(entries), np.arange(entries)] = 0
        for t in range(stop):
            if (best[t] > NEG).any():
                for end, _, s in self.steps(data, t):
                    np.maximum(best[end], best[t] + s, out=best[end])
        return best.T

    def middles(self, bodies: list[bytes]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
        """For each chunk the part between its first and last cut, all segmented at once: (cuts), ids, ids per chunk, scores."""
        ends = [self._head_and_tail(b) for b in bodies]
        parts = [b[f:g] if f >= 0 else b"" for b, (f, g) in zip(bodies, ends, strict=True)]
        offsets = np.zeros(len(parts) + 1, dtype=np.int64)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return ends, *self.texts(np.frombuffer(b"".join(parts), dtype=np.uint8), offsets)

    def transfer(self, body: bytes, ahead: bytes, cut: tuple[int, int], middle: float) -> np.ndarray:
        r = self.reach
        out = np.full((r, r), NEG)
        f, g = cut
        if f < 0:
            data = body + ahead
            entries = min(r, len(body) + 1)
            got = self._dense(data, len(body), entries)[:, len(body) : len(body) + r]
            out[:entries, : got.shape[1]] = got
            return out
        head = self._dense(body[:f], f, min(r, f + 1))[:, f]
        tail = self._dense(body[g:] + ahead, len(body) - g, 1)[0, len(body) - g : len(body) - g + r]
        out[: len(head), : len(tail)] = head[:, None] + middle + tail[None, :]
        return out

    def backtrace(self, body: bytes, ahead: bytes, entry: int, exit_: int, cut: tuple[int, int], middle: np.ndarray) -> np.ndarray:
        f, g = cut
        data = body + ahead
        if f < 0:
            return np.array(self.one(data, entry, len(body) + exit_)[0], dtype=np.int32)
        return np.concatenate([np.array(self.one(body[:f], entry)[0], dtype=np.int32), middle, np.array(self.one(data[g : len(body) + exit_])[0], dtype=np.int32)])


_LATTICES: dict[int, tuple[Vocabulary, Lattice]] = {}


def _lattice(v: Vocabulary) -> Lattice:
    """One lattice in each Python worker, kept for the tasks to come."""
    key = hash((len(v.pieces), v.pieces[-1], v.scores[-1], sum(map(len, v.pieces))))
    if key not in _LATTICES:
        _LATTICES[key] = (v, Lattice(v))
    return _LATTICES[key][1]


def _spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that isn't empty."""
    has = np.diff(offsets) > 0
    shift = np.concatenate([[0], np.cumsum(has)])
    out = np.full(len(raw) + int(has.sum()), 0x20, dtype=np.uint8)
    row_shift = np.repeat(shift[1:], np.diff(offsets))
    out[np.arange(len(raw)) + row_shift] = raw
    return out, offsets + shift


def _compose(mats: list[np.ndarray]) -> np.ndarray:
    out = mats[0]
    for m in mats[1:]:
        out = (out[:, :, None] + m[None, :, :]).max(axis=1)
    return out


_MAT = "doc_id long, chunk long, m array<double>"


def _giants(docs: DataFrame, shared, chunk_bytes: int) -> DataFrame:
    """(doc_id, token_ids, score) of long texts, by the scan over chunks."""
    n_parts = partitions(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = _lattice(shared.value).reach
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = b" " + text.encode()
                at, k = 0, 0
                while at < len(data):
                    end = min(at + chunk_bytes, len(data))
                    while end < len(data) and data[end] & 0xC0 == 0x80:
                        end += 1
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "chunk": k, "last": end == len(data), "body": data[at:end], "ahead": data[end : end + reach - 1]}], schema=pa.schema([("doc_id", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("body", pa.binary()), ("ahead", pa.binary())]))
                    at, k = end, k + 1

    chunks = checkpointed(docs.mapInArrow(cut, "doc_id long, chunk long, last boolean, body binary, ahead binary").repartition(n_parts, "doc_id", "chunk"))

    def matrices(batches):
        lat = _lattice(shared.value)
        for b in slices(batches, "body"):
            bodies, ahead = b.column("body").to_pylist(), b.column("ahead").to_pylist()
            cuts, _, _, score = lat.middles(bodies)
            rows = [lat.transfer(*x).ravel() for x in zip(bodies, ahead, cuts, score.tolist(), strict=True)]
            flat = list_array(pa.array(np.concatenate(rows)), np.full(len(rows), lat.reach**2))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("chunk"), flat], names=["doc_id", "chunk", "m"])

    def combine(batches):
        for g in grouped(batches, ["doc_id", "parent"]):
            r = _lattice(shared.value).reach
            m = _compose([np.array(x).reshape(r, r) for x in g.column("m").to_pylist()])
            yield pa.RecordBatch.from_arrays([g.column("doc_id").combine_chunks()[:1], g.column("parent").combine_chunks()[:1], pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["doc_id", "chunk", "m"])

    def hand_down(batches):
        for g in grouped(batches, ["doc_id", "parent"]):
            rows = g.to_pylist()
            r = _lattice(shared.value).reach
            mats = [np.array(x["m"]).reshape(r, r) for x in rows]
            alpha = np.full(r, NEG)
            alpha[rows[0]["entry"]] = 0
            reached = [alpha]
            for m in mats:
                reached.append((reached[-1][:, None] + m).max(axis=0))
            state, states = rows[0]["leave"], [rows[0]["leave"]]
            for m, a in zip(reversed(mats), reversed(reached[:-1]), strict=True):
                state = int(np.argmax(a + m[:, state]))
                states.append(state)
            states.reverse()
            yield pa.RecordBatch.from_arrays([pa.array([x["doc_id"] for x in rows]), pa.array([x["chunk"] for x in rows]), pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32())], names=["doc_id", "chunk", "entry", "leave"])

    def trace(batches):
        lat = _lattice(shared.value)
        for b in slices(batches, "body"):
            bodies, ahead = b.column("body").to_pylist(), b.column("ahead").to_pylist()
            cuts, ids, count, _ = lat.middles(bodies)
            begin = np.cumsum(count) - count
            states = zip(b.column("entry").to_pylist(), b.column("leave").to_pylist(), strict=True)
            rows = [lat.backtrace(body, more, i, j, cut, ids[s : s + n]) for body, more, (i, j), cut, s, n in zip(bodies, ahead, states, cuts, begin, count, strict=True)]
            flat = list_array(pa.array(np.concatenate(rows), pa.int32()), np.array([len(r) for r in rows]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("chunk"), flat], names=["doc_id", "chunk", "ids"])

    parent = F.expr(f"chunk div {FAN}")
    levels = [checkpointed(chunks.select("doc_id", "chunk", "body", "ahead").mapInArrow(matrices, _MAT))]
    while (levels[-1].agg(F.max("chunk")).first()[0] or 0) > 0:
        grown = levels[-1].withColumn("parent", parent).repartition(n_parts, "doc_id", "parent").sortWithinPartitions("doc_id", "parent", "chunk")
        levels.append(checkpointed(grown.mapInArrow(combine, _MAT)))
    r = F.lit(1)
    score = levels[-1].select("doc_id", F.element_at("m", r).alias("score"))
    states = levels[-1].select("doc_id", "chunk", F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for level in reversed(levels[:-1]):
        down = level.withColumn("parent", parent).join(states.withColumnRenamed("chunk", "parent"), ["doc_id", "parent"])
        down = down.repartition(n_parts, "doc_id", "parent").sortWithinPartitions("doc_id", "parent", "chunk").select("doc_id", "parent", "chunk", "m", "entry", "leave")
        states = checkpointed(down.mapInArrow(hand_down, "doc_id long, chunk long, entry int, leave int"))
    traced = chunks.join(states, ["doc_id", "chunk"]).select("doc_id", "chunk", "body", "ahead", "entry", "leave").mapInArrow(trace, "doc_id long, chunk long, ids array<int>")
    ids = traced.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda x: x["ids"])).alias("token_ids"))
    return ids.join(score, "doc_id")


def _piece_table(v: Vocabulary) -> pa.Array:
    """What each id stands for; after the pieces, the same ones without their first byte: for the space before a text."""
    return pa.array([*v.pieces, *(p[1:] for p in v.pieces)], pa.binary())


def _texts(table: pa.Array, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The texts of id lists that stand one after the other."""
    ids = np.array(ids, dtype=np.int32)
    ids[(np.cumsum(counts) - counts)[counts > 0]] += len(table) // 2
    return pc.binary_join(list_array(table.take(pa.array(ids)), counts), pa.scalar(b"", pa.binary())).cast(pa.string())


def encode(docs: DataFrame, model_path: str = MODEL, giant_bytes: int = GIANT_BYTES, chunk_bytes: int = CHUNK_BYTES, read_back: bool = False) -> DataFrame:
    """(doc_id, token_ids array<int>, score) for every row of ``docs`` (doc_id, text); with ``read_back`` also ``decoded``, the text of the ids.

    Null and empty texts have no tokens and score 0.  Repeated rows stay repeated rows, and rows without a
    doc_id stay, at every size: a giant text is worked on under a number of its own.  Other columns are not read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(model_path))  # of fixed size: the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattice(shared.value)
        table = _piece_table(shared.value) if read_back else None
        for part in slices(batches, limit=2 << 20):
            ids, count, score = lat.texts(*_spaced(*text_buffer(part.column("text"))))
            out = [part.column("doc_id").cast(pa.int64()), list_array(pa.array(ids, pa.int32()), count), pa.array(score)]
            back = [_texts(table, ids, count)] if read_back else []
            yield pa.RecordBatch.from_arrays([*out, *back], names=["doc_id", "token_ids", "score", *["decoded"] * read_back])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long_ = F.coalesce(F.octet_length("text"), F.lit(0)) > giant_bytes
    plain = docs.where(~long_).mapInArrow(run, "doc_id long, token_ids array<int>, score double" + ", decoded string" * read_back)
    giant = docs.where(long_)
    if giant.isEmpty():
        return plain
    giant = written(giant.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "giants")  # written, so the numbers stay
    rows = _giants(giant.select(F.col("row").alias("doc_id"), "text"), shared, chunk_bytes).withColumnRenamed("doc_id", "row")
    if read_back:
        rows = rows.join(decode(rows.select("row", "token_ids"), model_path).withColumnRenamed("text", "decoded"), "row")
    return plain.unionByName(rows.join(giant.select("row", "doc_id"), "row").drop("row"))


def decode(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """``tokens`` with ``token_ids`` turned into ``text``; null where the list is null.  Other columns stay (one named ``text`` is replaced)."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_vocabulary(model_path))
    kept = [c for c in tokens.columns if c not in ("token_ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _piece_table(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                lists = pc.fill_null(b.column("token_ids"), pa.scalar([], pa.list_(pa.int32()))) if b.column("token_ids").null_count else b.column("token_ids")
                text = _texts(table, np.asarray(lists.flatten()), np.asarray(pc.list_value_length(lists), dtype=np.int64))
                if b.column("token_ids").null_count:
                    text = pc.if_else(b.column("token_ids").is_valid(), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), text], names=[*kept, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name in kept)
    return tokens.select(*kept, "token_ids").mapInArrow(run, f"{schema}{', ' if kept else ''}text string")
