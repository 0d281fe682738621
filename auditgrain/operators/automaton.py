"""Many terms found in one pass: an Aho-Corasick automaton over the tokens of a text, stepped for a whole Arrow batch at once.

A token is a run of word characters or one other character that is not white space; it carries whether white space stands
before it.  Trie, failure links and the terms of each state are arrays; runs of known tokens are cut into pieces of
bounded length and all pieces of a batch take a step together.  The cost of a text does not depend on the number of terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of all terms up to which the automaton is broadcast (some 50 bytes each); beyond, terms are dealt to several automata.
LIMIT = 4_000_000
#: Tokens of a run that pass one after the other; longer runs are cut, with overlaps of the longest term.
RUN = 256
#: Bytes of texts that pass together.
SLICE = 1 << 20

_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[97:123] = True


class Automaton(NamedTuple):
    words: pa.Array  # distinct tokens of all terms
    letters: bool  # whether letters of all scripts are word characters, or only a-z
    edges: np.ndarray  # rising keys: state * 2 * words + symbol
    targets: np.ndarray
    fail: np.ndarray
    first: np.ndarray  # where the terms of a state begin in ``terms``; states + 1
    terms: np.ndarray  # numbers of the terms that end in a state, its failure states' included
    sizes: np.ndarray  # tokens of each term
    bare: np.ndarray  # terms without a word character, which may stand anywhere
    longest: int


class _Tokens(NamedTuple):
    begin: np.ndarray  # first byte
    end: np.ndarray
    gap: np.ndarray  # white space before
    text: pa.Array
    word: np.ndarray  # for each byte, whether it belongs to a word character


def _word_bytes(raw: np.ndarray, letters: bool) -> np.ndarray:
    if not letters or not (raw >= 128).any():
        return _ALNUM[raw]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    flag = np.zeros(int(points.max()) + 1, dtype=bool)  # by character; first which there are, without sorting them
    flag[points] = True
    kinds = np.flatnonzero(flag)
    flag[kinds] = [_ALNUM[p] if p < 128 else chr(p).isdecimal() or unicodedata.category(chr(p))[0] == "L" for p in kinds.tolist()]
    return np.repeat(flag[points], np.diff(np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))))


def _tokens(raw: np.ndarray, offsets: np.ndarray, letters: bool) -> _Tokens:
    """Tokens of lower-cased texts that stand one after the other; none crosses a text."""
    n = len(raw)
    word = _word_bytes(raw, letters)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    space = _SPACES[raw]
    start = ~space & ((raw & 0xC0) != 0x80)  # every other character is a token of its own
    start[1:] &= ~(word[1:] & word[:-1]) | edge[1:n]
    begin = np.flatnonzero(start)
    stop = ~space
    stop[:-1] &= start[1:] | space[1:] | edge[1:n]
    end = np.flatnonzero(stop) + 1
    gap = np.ones(len(begin), dtype=bool)
    if len(begin):
        later = begin > 0
        gap[later] = space[begin[later] - 1] | edge[begin[later]]
    sizes = np.zeros(len(begin) + 1, dtype=np.int64)
    np.cumsum(end - begin, out=sizes[1:])
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(sizes), pa.py_buffer(raw[~space])])
    return _Tokens(begin, end, gap, text, word)


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def build(terms: list[str], letters: bool = False) -> Automaton:
    """Automaton of lower-cased ``terms``; white space within them stands for any white space.  A term without tokens is never found."""
    raw, offsets = _buffer(pa.array(terms, pa.string()))
    t = _tokens(raw, offsets, letters)
    encoded = pc.dictionary_encode(t.text) if len(t.text) else None
    words = encoded.dictionary if encoded is not None else pa.array([], pa.large_binary())
    ids = np.asarray(encoded.indices, dtype=np.int64) if encoded is not None else np.zeros(0, dtype=np.int64)
    wide = 2 * len(words)
    owner = np.searchsorted(offsets, t.begin, side="right") - 1
    count = np.bincount(owner, minlength=len(terms))
    at = np.cumsum(count) - count
    symbol = 2 * ids + t.gap
    # the trie grows by one token of all terms at a time
    state, keys, targets, parents, ends, states = np.zeros(len(terms), dtype=np.int64), [], [], [], [], 1
    for depth in range(int(count.max(initial=0))):
        on = np.flatnonzero(count > depth)
        token = symbol[at[on] + depth] | (1 if depth == 0 else 0)  # what stands before the first token is free
        key, place = np.unique(state[on] * wide + token, return_inverse=True)
        keys.append(key)
        targets.append(np.arange(states, states + len(key)))
        parents.append(key)
        state[on] = states + place
        states += len(key)
        done = on[count[on] == depth + 1]
        ends.append(np.stack([state[done], done]))
    edges, targets = np.concatenate([*keys, np.zeros(0, dtype=np.int64)]), np.concatenate([*targets, np.zeros(0, dtype=np.int64)])
    order = np.argsort(edges, kind="stable")
    edges, targets = edges[order], targets[order]
    auto = Automaton(words, letters, edges, targets, np.zeros(states, dtype=np.int64), np.zeros(0), np.zeros(0), count, np.zeros(0), int(count.max(initial=0)))
    fail = auto.fail
    for depth, key in enumerate(parents):  # by rising depth: failure states are nearer to the root
        if depth and len(key):
            fail[_next(auto, key // wide, key % wide)] = _next(auto, fail[key // wide], key % wide)
    own = np.concatenate([*ends, np.zeros((2, 0), dtype=np.int64)], axis=1)
    holds: list[list[int]] = [[] for _ in range(states)]
    for s, k in own.T.tolist():
        holds[s].append(k)
    depth_of = np.concatenate([[0], *[np.full(len(k), d + 1) for d, k in enumerate(parents)]]).astype(np.int64)
    for s in np.argsort(depth_of, kind="stable").tolist():
        if s and fail[s]:
            holds[s] = holds[s] + holds[fail[s]]
    first = np.zeros(states + 1, dtype=np.int64)
    np.cumsum([len(h) for h in holds], out=first[1:])
    listed = np.array([k for h in holds for k in h], dtype=np.int64)
    worded = np.bincount(owner, weights=t.word[t.begin], minlength=len(terms)) if len(t.begin) else np.zeros(len(terms))
    return auto._replace(first=first, terms=listed, bare=worded == 0)


def _next(a: Automaton, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The states after ``symbol``; failure links are followed until an edge is found or the root is left without one."""
    wide, state = 2 * len(a.words), state.copy()
    out = np.zeros(len(state), dtype=np.int64)
    open_ = np.arange(len(state))
    while len(open_):
        s = state[open_]
        key = s * wide + np.where(s == 0, symbol[open_] | 1, symbol[open_])
        place = np.minimum(np.searchsorted(a.edges, key), max(len(a.edges) - 1, 0))
        hit = a.edges[place] == key if len(a.edges) else np.zeros(len(key), dtype=bool)
        out[open_[hit]] = a.targets[place[hit]]
        open_ = open_[~hit & (s != 0)]
        state[open_] = a.fail[state[open_]]
    return out


def scan(a: Automaton, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, start, end) of every hit in lower-cased texts, places in characters; hits are whole words."""
    none = np.zeros(0, dtype=np.int64)
    raw, offsets = _buffer(column)
    if not len(raw) or not len(a.words):
        return none, none, none, none
    t = _tokens(raw, offsets, a.letters)
    ids = np.asarray(pc.fill_null(pc.index_in(t.text, value_set=a.words), -1), dtype=np.int64)
    row = np.searchsorted(offsets, t.begin, side="right") - 1
    known = np.flatnonzero(ids >= 0)
    if not len(known):
        return none, none, none, none
    fresh = np.append(True, (np.diff(known) != 1) | (np.diff(row[known]) != 0))
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(known)))
    # pieces of long runs: each begins longest - 1 tokens early, from the root, and reports what ends in its own part
    parts = -(-size // RUN)
    piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    lead = np.where(piece > 0, a.longest - 1, 0)
    begin = np.repeat(start, parts) + piece * RUN - lead
    stop = np.minimum(np.repeat(start, parts) + (piece + 1) * RUN, np.repeat(start + size, parts))
    low = np.repeat(start, parts)
    lead, begin = np.minimum(lead, begin + lead - low), np.maximum(begin, low)
    length = stop - begin
    order = np.argsort(-length, kind="stable")
    begin, length, lead = begin[order], length[order], lead[order]
    symbol = 2 * ids[known] + t.gap[known]
    state = np.zeros(len(begin), dtype=np.int64)
    at, states = [], []
    for step in range(int(length[0])):
        on = int(np.searchsorted(-length, -step, side="left"))  # pieces longer than step come first
        state[:on] = _next(a, state[:on], symbol[begin[:on] + step])
        some = np.flatnonzero((a.first[state[:on] + 1] > a.first[state[:on]]) & (step >= lead[:on]))
        at.append(known[begin[some] + step])
        states.append(state[some])
    at, states = np.concatenate(at), np.concatenate(states)
    n = a.first[states + 1] - a.first[states]
    term = a.terms[np.repeat(a.first[states] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    last = np.repeat(at, n)
    head = last - a.sizes[term] + 1
    b, e = t.begin[head], t.end[last]
    where = row[last]
    before = (b > offsets[where]) & t.word[np.maximum(b - 1, 0)]
    after = (e < offsets[where + 1]) & t.word[np.minimum(e, len(raw) - 1)]
    keep = (~before & ~after) | a.bare[term]
    where, term, b, e = where[keep], term[keep], b[keep], e[keep]
    chars = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=chars[1:])
    base = chars[offsets[where]]
    return where, term, chars[b] - base, chars[e] - base


def automata(terms: list[str], letters: bool = False, limit: int = LIMIT) -> list[tuple[np.ndarray, Automaton]]:
    """Automata of at most about ``limit`` characters each, with the numbers of their terms."""
    size = np.cumsum([len(t) + 1 for t in terms])
    group = size // (limit + 1) if len(terms) else np.zeros(0, dtype=np.int64)
    return [(np.flatnonzero(group == g), build([terms[i] for i in np.flatnonzero(group == g)], letters)) for g in np.unique(group)]


def term_hits(rows: DataFrame, terms: DataFrame | list[str], text: str = "text", letters: bool = False, limit: int = LIMIT) -> DataFrame:
    """``rows`` without ``text``, with ``hits`` array<struct<term, start, end>>: every whole-word hit of a term, case aside, by place.

    ``terms`` is a list, or has term, a string column; repeated and blank ones count once and never.  Word characters are a-z and 0-9, with ``letters``
    letters and digits of all scripts; none may stand next to a hit, but a term without any may stand anywhere.  White space within a term
    matches any white space.  Places are in characters of the text; hits may overlap.  A null text has none.

    Terms reach the driver, ``limit`` characters at a time are broadcast as one automaton; beyond that, rows pass several ones in
    the same task.  Rows are neither joined nor shuffled."""
    if isinstance(terms, list):
        listed = sorted({t.strip(" ") for t in terms} - {""})
    else:
        listed = sorted(r["t"] for r in terms.select(F.trim("term").alias("t")).where("t <> ''").distinct().toLocalIterator())
    lowered = [r["x"] for r in rows.sparkSession.createDataFrame([(t,) for t in listed], "t string").select(F.lower("t").alias("x")).collect()] if any(not t.isascii() for t in listed) else [t.lower() for t in listed]
    context = rows.sparkSession.sparkContext
    shared = [context.broadcast(x) for x in automata(lowered, letters, limit)]
    names = [c for c in rows.columns if c != text]
    kind = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    values = context.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = pa.array(values.value, pa.string())
        for part in _sliced(batches):
            column = part.column("__lower")
            found = [np.zeros((4, 0), dtype=np.int64)]
            for one in shared:
                numbers, a = one.value
                row, term, start, end = scan(a, column)
                found.append(np.stack([row, numbers[term], start, end]))
            row, term, start, end = np.concatenate(found, axis=1)
            order = np.lexsort((term, end, start, row))
            row, term, start, end = (x[order] for x in (row, term, start, end))
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([named.take(pa.array(term)), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["term", "start", "end"])
            hits = pa.ListArray.from_arrays(pa.array(bounds), items)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), hits.cast(kind)], names=[*names, "hits"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text] + ["hits array<struct<term: string, start: int, end: int>>"])
    return rows.select(*names, F.lower(text).alias("__lower")).mapInArrow(run, schema)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column("__lower")), 0), dtype=np.int64)
        block = np.cumsum(sizes) // SLICE if len(sizes) else sizes
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            if end > start:
                yield batch.slice(start, end - start)
