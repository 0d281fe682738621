"""Benchmark decontamination on templates.

Words are made canonical (lower case, outer punctuation off); numbers, names and units become typed
placeholders, and neighbouring numbers or names one placeholder, so that a name of one word may stand for a name of three.
Windows of placeholders and words of documents are hash-joined with those of the benchmark, so a question
whose numbers or names were changed still matches; slot consistency (each value of the item always stands
for the same value of the document) tells it from chance.  A window with few literal words
is compared as written, and a longer one of up to twelve words around it stands for it too if that has enough of them.  An item shorter than a window is one window of its own length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytekit import BASE, MIX_A, Poly, list_array, lower_ascii, mix, slices, text_buffer, trimmed, word_spans

WINDOW = 8
#: Of so many words of a window, at least five eighths must be literal for its template to count.
LITERALS = 5
#: Words of the window that stands for one with too few literal words (fewer in shorter items).
DENSE = 12
#: An item of fewer words than this is held only by a document that is nothing else.
SHORT = 4
#: Benchmark windows up to this number (16 MB) are sent to every task; more are joined by shuffling.
BROADCAST_WINDOWS = 2_000_000
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))
_UNITS = """kg g mg t km m cm mm l ml ha kmh mph hz kw kwh w v °c °f hours hour minutes minute seconds second days day weeks week months month years year
miles mile feet foot inches inch yards pounds pound ounces tons dollars euros cents percent degrees litres liters metres meters kilometres kilometers grams
stunden stunde tage tag jahre euro meter liter prozent heures heure jours jour ans mètres litres horas hora días día años metros litros euros""".split()
_NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half".split()
#: Words that are no names even where they begin a sentence.
_COMMON = """the a an if in on at of for to by from with and or but as is are was were be been do does did has have had will would can could should may might must
what when where which who whom whose why how there here this that these those it he she they we you i his her their our your my its each every all some any no not
then than so because after before while during since until let find show given suppose assume calculate compute determine solve write name choose answer question
der die das ein eine und oder in im am an auf von zu mit für ist sind war wenn was wie wer wo le la les un une des du de et ou dans sur par pour est sont si que qui
el los las una unos y o en por para es son si como cuando donde""".split()
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[48:58] = 1


def _known(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in dict.fromkeys(words)]
    ends = np.cumsum([len(w) for w in data])
    return np.unique(Poly(np.frombuffer(b"".join(data), dtype=np.uint8)).ranges(np.concatenate([[0], ends[:-1]]), ends) | np.uint64(1))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def canonical(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(template token, slot value or 0 where literal, words of each row) of all rows of ``text``, after folding."""
    raw, offsets = text_buffer(part.column("text"))
    starts, ends, first = word_spans(raw, offsets)
    row = np.repeat(np.arange(part.num_rows), np.diff(first))
    none = np.zeros(0, dtype=np.uint64)
    if not len(starts):
        return none, none, np.zeros(part.num_rows, dtype=np.int64)
    b, e = trimmed(raw, starts, ends, _PUNCT)
    b, e, row = b[b < e], e[b < e], row[b < e]
    if not len(b):
        return none, none, np.zeros(part.num_rows, dtype=np.int64)
    h = Poly(lower_ascii(raw)).ranges(b, e) | np.uint64(1)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[raw])])
    number = (digits[e] > digits[b]) | _among(h, _known(_NUMBERS))
    unit = np.zeros(len(b), dtype=bool)
    unit[1:] = _among(h, _known(_UNITS))[1:] & number[:-1] & (row[1:] == row[:-1])
    name = (raw[b] >= 65) & (raw[b] <= 90) & ~number & ~unit & ~_among(h, _known(_COMMON))
    kind = np.where(number, 1, np.where(unit, 2, np.where(name, 3, 0)))
    begin = np.ones(len(b), dtype=bool)
    begin[1:] = (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 0) | (kind[1:] == 2)
    at = np.flatnonzero(begin)
    turn = np.arange(len(b)) - np.repeat(at, np.diff(np.append(at, len(b))))
    value = np.add.reduceat(mix(h + turn.astype(np.uint64) * MIX_A), at)  # of a literal word too
    kind = kind[at]
    token = np.select([kind == 1, kind == 2, kind == 3], [_NUM, _UNIT, _NAME], value)
    return token, np.where(kind > 0, value | np.uint64(1), np.uint64(0)), np.bincount(row[at], minlength=part.num_rows)


def template_windows(token: np.ndarray, slot: np.ndarray, counts: np.ndarray, size: int, rows: np.ndarray):
    """(hash, row, word number, place, open) of the windows of ``size`` words in the marked ``rows``.

    The hash is that of the template where the window is open: five eighths of up to WINDOW words, or LITERALS of more, are literal; else
    that of the words as written."""
    begin = np.cumsum(counts) - counts
    span = np.where(rows, np.maximum(counts - size + 1, 0), 0)
    total = int(span.sum())
    r = np.repeat(np.arange(len(counts)), span)
    pos = np.arange(total) - np.repeat(np.cumsum(span) - span, span)
    at = begin[r] + pos
    open_ = _open(slot, at, size)
    h = np.empty(total, dtype=np.uint64)
    exact = np.where(slot == 0, token, slot)
    for on, words in ((open_, token), (~open_, exact)):
        acc, place = np.full(int(on.sum()), np.uint64(size)), at[on]
        for k in range(size):
            acc = acc * BASE + words[place + k]
        h[on] = mix(acc if words is token else acc ^ MIX_A)
    return h, r, pos, at, open_


def _open(slot: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    literal = np.concatenate([[0], np.cumsum(slot == 0)])
    return (literal[at + size] - literal[at]) * WINDOW >= LITERALS * min(size, WINDOW)


_DDL = "id long, h long, pos int, start int, slots array<long>"


def _emit(part: pa.RecordBatch, key: str, sizes: list[int] | None, wanted: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Windows of documents, of WINDOW words and of the other ``sizes`` that items have; without ``sizes``, those of items.

    Longer windows than WINDOW are made only around windows that are not open.  In items they stand for such a one too: they have its ``pos``
    and a ``start`` of their own."""
    token, slot, counts = canonical(part)

    def batch(h, row, pos, at, size, start=None):
        start = pos if start is None else start
        if wanted is not None:
            on = _among(h, wanted) if len(wanted) else np.zeros(len(h), dtype=bool)
            h, row, pos, at, start = h[on], row[on], pos[on], at[on], start[on]
        values = slot[(at[:, None] + np.arange(size)).ravel()] if len(at) else np.zeros(0, dtype=np.uint64)
        ids = part.column(key).cast(pa.int64()).take(pa.array(row))
        return pa.RecordBatch.from_arrays([ids, pa.array(h.view(np.int64)), pa.array(pos, pa.int32()), pa.array(start, pa.int32()), list_array(pa.array(values.view(np.int64)), np.full(len(h), size))], names=["id", "h", "pos", "start", "slots"])

    for size in range(1, WINDOW):
        rows = counts == size if sizes is None or size < SHORT else counts >= size
        if (sizes is None or size in sizes) and rows.any():
            yield batch(*template_windows(token, slot, counts, size, rows)[:4], size)
    if not (counts >= WINDOW).any():
        return
    h, row, pos, at, open_ = template_windows(token, slot, counts, WINDOW, counts >= WINDOW)
    shut = np.zeros(len(token) + 1, dtype=np.int64)
    shut[at[~open_] + 1] = 1
    shut = np.cumsum(shut)
    yield batch(h, row, pos, at, WINDOW)
    for size in range(WINDOW + 1, DENSE + 1):
        rows = (counts >= size if size == DENSE else counts == size) if sizes is None else counts >= size
        if (sizes is not None and size not in sizes) or not rows.any() or open_.all():
            continue
        begin = np.cumsum(counts) - counts
        if sizes is None:  # of an item: the window that holds the one it stands for, inside the item
            own = np.flatnonzero(~open_ & rows[row])
            first = np.minimum(pos[own], counts[row[own]] - size)
            there = _open(slot, begin[row[own]] + first, size)
            which = np.stack([row[own[there]], pos[own[there]], first[there]], axis=1)
        else:
            span = np.where(rows, counts - size + 1, 0)
            r = np.repeat(np.arange(len(counts)), span)
            first = np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
            place = begin[r] + first
            on = (shut[place + size - WINDOW + 1] > shut[place]) & _open(slot, place, size)
            which = np.stack([r[on], first[on], first[on]], axis=1)
        place = begin[which[:, 0]] + which[:, 2]
        acc = np.full(len(which), np.uint64(size))
        for k in range(size):
            acc = acc * BASE + token[place + k]
        if len(which):
            yield batch(mix(acc), which[:, 0], which[:, 1], place, size, which[:, 2])


def _windows(df: DataFrame, key: str, sizes: list[int] | None = None, wanted=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield from _emit(part, key, sizes, wanted.value if wanted is not None else None)

    return df.where(F.col("text").isNotNull() & F.col(key).isNotNull()).select(key, "text").mapInArrow(run, _DDL)


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_matched, coverage, kind): benchmark items that ``docs`` hold.

    An item counts as held when at least ``coverage`` of its windows stand in one place of the document (at
    one displacement, or at several within half the item's length) and the slots are consistent there;
    kind is verbatim where the whole item stands there with equal values, partial where a part of it does, else template.  Items of fewer than WINDOW words are one
    window; of fewer than SHORT, held by documents that are nothing else.  Null and empty texts match
    nothing; items of one item_id are one item, repeated rows of a doc_id one document.  Other columns are not read."""
    items = _windows(benchmark.select("item_id", "text"), "item_id").distinct()
    found = items.agg(F.count_distinct("h").alias("n"), F.collect_set(F.size("slots")).alias("sizes")).first()  # WINDOW sizes at most
    sizes = sorted(set(found["sizes"]) - {WINDOW})
    spark = docs.sparkSession
    if found["n"] <= broadcast_windows:
        hashes = np.array([r["h"] for r in items.select("h").distinct().collect()], dtype=np.int64).view(np.uint64)
        hashes.sort()
        seen = _windows(docs, "doc_id", sizes, spark.sparkContext.broadcast(hashes))
    else:
        seen = _windows(docs, "doc_id", sizes)
    lengths = items.groupBy(F.col("id").alias("item_id")).agg(F.count_distinct("pos").alias("n_windows"))
    a, b = seen.alias("a"), items.alias("b")
    pairs = a.join(b, F.col("a.h") == F.col("b.h")).select(
        F.col("a.id").alias("doc_id"), F.col("b.id").alias("item_id"), (F.col("a.start") - F.col("b.start")).alias("shift"), F.col("b.pos").alias("pos"),
        F.filter(F.arrays_zip(F.col("b.slots").alias("i"), F.col("a.slots").alias("d")), lambda x: x["i"] != 0).alias("slots"),
    )
    wide = F.greatest(F.col("n_windows"), F.lit(WINDOW))  # places overlap by half, so two near displacements share one
    places = F.array(
        F.struct(F.lit(0).alias("way"), F.col("shift").cast("long").alias("at")), F.struct(F.lit(1).alias("way"), F.floor(F.col("shift") / wide).alias("at")),
        F.struct(F.lit(2).alias("way"), F.floor((F.col("shift") + wide / 2) / wide).alias("at")),
    )
    at = (
        pairs.join(lengths, "item_id").withColumn("place", F.explode(places)).groupBy("doc_id", "item_id", "place")
        .agg(F.count_distinct("pos").alias("n_matched"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), F.first("n_windows").alias("n_windows"))
    )
    distinct = lambda f: F.size(F.array_distinct(F.transform("slots", lambda x: x[f])))  # noqa: E731  (a value of the item has one of the document)
    checked = (
        at.withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
        .where((F.col("coverage") >= coverage) & (distinct("i") == F.size("slots")))
        .withColumn("kind", F.when(F.exists("slots", lambda x: x["i"] != x["d"]), "template").when(F.col("n_matched") < F.col("n_windows"), "partial").otherwise("verbatim"))
    )
    return checked.groupBy("doc_id", "item_id").agg(F.max("n_matched").alias("n_matched"), F.max("coverage").alias("coverage"), F.max_by("kind", F.struct("n_matched", "kind")).alias("kind"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5) -> DataFrame:
    """``docs`` without those that hold a benchmark item; columns as given."""
    return docs.join(contamination(docs, benchmark, coverage).select("doc_id").distinct(), "doc_id", "left_anti")
