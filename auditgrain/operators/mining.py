"""Deterministic text mining with lexicons: baselines with the schema of a model's output, for whole corpora."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text as tx
from .automaton import term_hits
from .spans import line_regions
from .wordsets import cuts, distinct, runs, starts, whole_groups

#: Lexicons for English corporate texts: defaults of the miners below; others are parameters.
CLAIM_LEXICON = {
    "commitment": ["will", "shall", "plan to", "aim to", "aims to", "commit to", "committed to", "target", "targets", "pledge", "pledges", "goal", "ambition", "by 2030", "by 2050", "net zero"],
    "certification": ["certified", "certification", "accredited", "verified by", "audited", "label", "ecolabel", "iso 14001", "b corp", "compliant with"],
    "comparative": ["more than", "less than", "compared with", "compared to", "lower than", "higher than", "better than", "reduced", "reduction", "increase", "fewer", "best", "leading"],
    "vague_attribute": ["sustainable", "sustainably", "green", "eco-friendly", "environmentally friendly", "natural", "clean", "responsible", "conscious", "climate friendly", "planet"],
    "factual": ["is", "are", "was", "were", "has", "have", "uses", "contains", "made of", "made from"],
}
MARK_LEXICON = {
    "hedge": ["may", "might", "could", "can help", "expected to", "seek to", "strive", "where possible", "if feasible", "likely", "intend", "intends"],
    "vague_term": ["sustainable", "green", "eco-friendly", "environmentally friendly", "natural", "clean", "responsible", "ethical", "conscious", "planet-friendly", "low impact"],
    "comparative": ["more", "less", "better", "lower", "higher", "greener", "cleaner", "fewer", "improved", "reduced"],
    "weak_verb": ["support", "supports", "contribute", "contributes", "help", "helps", "promote", "promotes", "encourage", "explore", "exploring"],
    "intensifier": ["very", "truly", "fully", "completely", "totally", "highly", "significantly", "substantially", "100%", "always"],
    "approximation": ["about", "around", "approximately", "nearly", "almost", "roughly", "up to", "at least", "more than"],
    "responsibility": ["our suppliers", "our partners", "the industry", "consumers", "everyone", "together", "third parties"],
    "ratio": ["per cent", "percent", "half of", "a third of", "a quarter of", "one in", "out of", "share of", "majority of"],
}

QUANTITY = r"(\d[\d,.]*\s?(?:%|percent|tonnes|tons|kg|km|million|billion|mt|gwh|mwh)?)"
YEAR = r"\b((?:19|20)\d{2})\b"
BASELINE = r"\b((?:since|from|against|compared with|versus|than) (?:the )?(?:19|20)\d{2})\b"


def _cut(text: Column) -> Column:
    """Pieces of a text: it is cut after . ! or ? before a space, and after a line's end."""
    return F.split(text, r"(?<=[.!?\n])(?:(?<=\n)|(?= ))")


def _placed(text: Column) -> Column:
    """Sentences of a text as array<struct<at, piece>>: where each begins, and what stands there up to the next, a line's end included."""
    put = lambda p: F.zip_with(p, tx.running_ends(F.transform(p, lambda x: F.length(x))), lambda x, end: F.struct((end - F.length(x)).alias("at"), x.alias("piece")))
    return F.filter(tx.let(_cut(text), put), lambda x: F.btrim(x["piece"], F.lit(" \n")) != "")


def _exploded(docs: DataFrame, key: str, number: str, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(document_id, ``number``, start, end, text) of the sentences of each row of docs, of those only whose text ``keep`` holds for.

    All of a document is worked out in its row, and numbers are places in its array: texts are dealt out by document
    once, as a file may be a single split, and neither sorted nor shuffled again."""
    text = lambda x: F.btrim(x["piece"], F.lit(" \n"))
    found = _placed(F.col("text"))
    if keep is not None:
        found = F.filter(found, lambda x: keep(text(x)))
    rows = docs.select(F.col(key).alias("document_id"), "text").repartition("document_id").select("document_id", F.posexplode(found).alias("no", "x"))
    lead = F.length("x.piece") - F.length(F.ltrim("x.piece"))
    placed = rows.select("document_id", (F.col("no") + 1).alias(number), (F.col("x.at") + lead).cast("long").alias("start"), text(F.col("x")).alias("text"))
    return placed.select("document_id", number, "start", (F.col("start") + F.length("text")).alias("end"), "text")


def sentence_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document_id, sentence_no, text): ``sentences`` without their places, which cost more than the cutting."""
    trimmed = F.filter(F.transform(_cut(F.col("text")), lambda x: F.btrim(x, F.lit(" \n"))), lambda x: x != "")
    return docs.select(F.col(key).alias("document_id"), "text").repartition("document_id").select("document_id", F.posexplode(trimmed).alias("no", "text")).select("document_id", (F.col("no") + 1).alias("sentence_no"), "text")


def sentences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document_id, sentence_no, start, end, text): lines cut after . ! or ?, with places in the text; a row of docs is a document."""
    return _exploded(docs, key, "sentence_no")


def _has(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands in the text, case aside."""
    return text.rlike(r"(?i)(?<![\p{L}\d])(" + "|".join(rf"\Q{w}\E" for w in words) + r")(?![\p{L}\d])") if words else F.lit(False)


def _kind(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """First kind of the lexicon, in its order, that has a word in the text; null if none has."""
    return F.coalesce(F.lit(None).cast("string"), *(F.when(_has(text, words), kind) for kind, words in lexicon.items()))


#: Kinds of regions whose sentences are no claims of the company.
NOT_CLAIMED = ("footnote", "cautionary", "third_party_quote")


def quoted_regions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document_id, kind, start, end): lines that stand in quotation marks, but for who says so in up to eight words or after a dash."""
    lines = line_regions(docs, key)
    quoted = F.trim("text").rlike(r"""^["“„«].*["”“»][.,;]?(\s*[-–—].*|\s+\S+(\s+\S+){0,7})?$""")
    return lines.where(quoted).select("document_id", F.lit("third_party_quote").alias("kind"), "start", "end")


def mine_claims(docs: DataFrame, lexicon: dict[str, list[str]] = CLAIM_LEXICON, key: str = "doc_id", regions: DataFrame | None = None, excluded: tuple[str, ...] = NOT_CLAIMED) -> DataFrame:
    """Sentences with a word of the lexicon as claims; the type is its first kind that occurs.

    ``regions`` (document_id, kind, start, end): a sentence that begins in a region of a kind in ``excluded`` is no claim.  Regions may nest
    and overlap; sentences and regions meet by document and bin, so a document of many of either is no hot key."""
    rows = _exploded(docs, key, "claim_id", lambda text: _has(text, sum(lexicon.values(), [])))
    if regions is not None:
        from .matching import BIN, binned

        shut = binned(regions.where(F.col("kind").isin(*excluded)).select("document_id", "start", "end")).withColumnsRenamed({"start": "__s", "end": "__e"})
        rows = rows.withColumn("__bin", F.floor(F.col("start") / BIN)).alias("r").join(
            shut.alias("x"), (F.col("r.document_id") == F.col("x.document_id")) & (F.col("r.__bin") == F.col("x.__bin")) & (F.col("r.start") >= F.col("x.__s")) & (F.col("r.start") < F.col("x.__e")), "left_anti").drop("__bin")
        rows = rows.withColumn("claim_id", F.row_number().over(Window.partitionBy("document_id").orderBy("start")))
    return rows.select("document_id", "claim_id", _kind(F.col("text"), lexicon).alias("type"), "start", "end", "text")


def extract_quantities(claims: DataFrame) -> DataFrame:
    """claims with quantity, baseline and timeframe as written; null where absent."""
    got = lambda p: F.nullif(F.regexp_extract("text", "(?i)" + p, 1), F.lit(""))
    return claims.withColumns({"quantity": got(QUANTITY), "baseline": got(BASELINE), "timeframe": got(YEAR)})


def mark_claims(claims: DataFrame, lexicon: dict[str, list[str]] = MARK_LEXICON) -> DataFrame:
    """claims without text, with ``marks`` array<struct<kind, start, end, term>>: every whole-word hit of the lexicon, with its place.

    One pass over the claims finds all terms, however many; a term of several kinds gives a mark of each.  Marks stay with their claim."""
    kinds: dict[str, list[str]] = {}
    for kind, words in lexicon.items():
        for w in words:
            if kind not in kinds.setdefault(w.strip().lower(), []):
                kinds[w.strip().lower()].append(kind)
    of = F.from_json(F.lit(json.dumps(kinds)), "map<string, array<string>>")
    hits = term_hits(claims, list(kinds), letters=True)
    mark = lambda h: F.transform(F.try_element_at(of, h["term"]), lambda k: F.struct(k.alias("kind"), (F.col("start") + h["start"]).alias("start"), (F.col("start") + h["end"]).alias("end"), h["term"].alias("term")))
    return hits.withColumn("marks", F.flatten(F.transform("hits", mark))).drop("hits")


def mine_signals(claims: DataFrame, lexicon: dict[str, list[str]] = MARK_LEXICON) -> DataFrame:
    """(document_id, claim_id, kind, start, end, term): the marks of ``mark_claims``, a row for each."""
    marked = mark_claims(claims.select("document_id", "claim_id", "start", "text"), lexicon)
    return marked.select("document_id", "claim_id", F.inline("marks"))


def _polarity() -> Column:
    return F.when(F.col("baseline").isNotNull(), "credit").when(F.col("quantity").isNotNull() | F.col("timeframe").isNotNull(), "benign").otherwise("flag")


def _clarity(flags: Column, vague: Column) -> list[Column]:
    """dimension, score and confidence of a claim that has flags, and vague terms, or not."""
    number = F.col("quantity").isNotNull()
    score = F.when(vague & ~number, 0.8).when(flags & ~number, 0.55).when(flags | vague, 0.4).when(number, 0.15).otherwise(0.3)
    return [F.lit("clarity").alias("dimension"), score.alias("score"), F.when(number, 0.9).otherwise(0.8).alias("confidence")]


def assign_polarity(signals: DataFrame, claims: DataFrame) -> DataFrame:
    """Marks in a claim with a baseline are credit, with a number or year benign, else flags."""
    q = claims.select("document_id", "claim_id", "quantity", "baseline", "timeframe")
    return signals.join(q, ["document_id", "claim_id"], "left").withColumn("polarity", _polarity()).drop("quantity", "baseline", "timeframe")


def score_clarity(claims: DataFrame, signals: DataFrame) -> DataFrame:
    """(document_id, claim_id, dimension, score, confidence) by bands: vague .8, flags alone .55, flags with a number .4, a number .15, else .3."""
    n = signals.groupBy("document_id", "claim_id").agg(F.count_if(F.col("polarity") == "flag").alias("flags"), F.count_if(F.col("kind") == "vague_term").alias("vague"))
    return claims.join(n, ["document_id", "claim_id"], "left").select("document_id", "claim_id", *_clarity(F.col("flags") > 0, F.col("vague") > 0))


def clarity_of_claims(claims: DataFrame, lexicon: dict[str, list[str]] = MARK_LEXICON) -> DataFrame:
    """(document_id, claim_id, polarity, dimension, score, confidence): ``score_clarity`` of the claims' own marks, with the polarity that ``assign_polarity`` gives them; null without marks.

    claims have quantity, baseline and timeframe.  They are made once and pass in one go: marks are not joined back."""
    marked = mark_claims(claims.select("document_id", "claim_id", "start", "text", "quantity", "baseline", "timeframe"), lexicon)
    rows = marked.withColumn("polarity", F.when(F.size("marks") > 0, _polarity())).withColumn("vague", F.exists("marks", lambda m: m["kind"] == "vague_term"))
    return rows.select("document_id", "claim_id", "polarity", *_clarity(F.coalesce(F.col("polarity") == "flag", F.lit(False)), F.col("vague")))


def nearest_passages(docs: DataFrame, topics: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, topic, nearest, start): the sentence that shares most of a topic's content words, the first of several; topics: topic, term."""
    words = topics.select("topic", F.explode(tx.content_words(F.col("term"))).alias("w")).distinct()
    s = sentences(docs, key)
    tokens = s.select("document_id", "sentence_no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)))).alias("w"))
    shared = tokens.join(words, "w").groupBy("document_id", "topic", "sentence_no").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("document_id", "topic").agg(F.max_by("sentence_no", F.struct("n", -F.col("sentence_no"))).alias("sentence_no"))
    return best.join(s, ["document_id", "sentence_no"]).select(F.col("document_id").alias(key), "topic", F.col("text").alias("nearest"), "start")


def mine_omissions(docs: DataFrame, topics: DataFrame, base: float = DEFAULT.omission_score, penalty: float = DEFAULT.omission_penalty, key: str = "doc_id") -> DataFrame:
    """(document, topic, score, nearest): topics of which less than half of the terms stand in the text, with the nearest
    passage.  Half is the rule, not none, as a score is to be lowered where terms are there: with no term at all that could never happen; where terms are there but no passage is near, the score is multiplied by ``penalty``."""
    from .knowledge import topic_coverage

    n = topics.groupBy("topic").agg(F.count_distinct("term").alias("n"))
    c = topic_coverage(docs, topics, key).join(n, "topic").where(F.coalesce(F.size("seen"), F.lit(0)) * 2 < F.col("n"))
    near = nearest_passages(docs, topics, key).select(key, "topic", "nearest")
    score = F.when(~F.col("absent") & F.col("nearest").isNull(), base * penalty).otherwise(base)
    return c.join(near, [key, "topic"], "left").select(key, "topic", score.alias("score"), "nearest")


def compare_versions(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, side, n, share): sentences kept, dropped and added between two versions, by their squashed text."""
    h = lambda d: d.select(key, F.xxhash64(tx.squash(F.col("text"))).alias("h")).distinct()
    both = h(old).withColumn("o", F.lit(1)).join(h(new).withColumn("n", F.lit(1)), [key, "h"], "full")
    side = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "dropped").otherwise("kept")
    per = both.groupBy(key, side.alias("side")).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(key)))


def _best_chain(old: list[int], new: list[int], weight: list[float]) -> list[tuple[int, int]]:
    """Of pairs sorted by old number and falling new number, the heaviest set that rises in both numbers."""
    rank = {v: i + 1 for i, v in enumerate(sorted(set(new)))}
    tree = [(0.0, -1)] * (len(rank) + 1)  # best chain that ends at a new number of at most this rank
    best, before = [], []
    for k, (n, w) in enumerate(zip(new, weight, strict=True)):
        i, top = rank[n] - 1, (0.0, -1)
        while i > 0:
            top = max(top, tree[i], key=lambda x: x[0])
            i -= i & -i
        best.append(top[0] + w)
        before.append(top[1])
        i = rank[n]
        while i < len(tree):
            if best[k] > tree[i][0]:
                tree[i] = (best[k], k)
            i += i & -i
    k, out = max(range(len(best)), key=lambda k: best[k], default=-1), []
    while k >= 0:
        out.append((old[k], new[k]))
        k = before[k]
    return out


def _near(group: np.ndarray, side: np.ndarray, size: np.ndarray, word: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(old, new, weight): rows of one group that share ``bar`` of the smaller one's words, in the order of _best_chain; rows are sorted by group.

    ``word`` has the codes of all rows' words, ``size`` of them for each row.  Two rows with that share have one of the rarest words of the smaller one in
    common, all but as many as it must share less one, so they meet on those only (each side may be the smaller one) and are compared once."""
    n, row, found = len(size), np.repeat(np.arange(len(size)), size), [np.zeros(0, "int64")]
    keys, word = np.unique(group[row] * (int(word.max(initial=0)) + 1) + word, return_inverse=True)
    count = lambda mine: [np.bincount(word[m], minlength=len(keys)) for m in mine]
    df = count([side[row] == s for s in (0, 1)])
    both = ((df[0] > 0) & (df[1] > 0))[word]
    row, word = row[both], word[both]
    mine = [side[row] == s for s in (0, 1)]
    df, met = count(mine), np.bincount(row, minlength=n)
    need = np.maximum(np.ceil(bar * size - 1e-9), 1).astype("int64")
    for s, o in ((0, 1), (1, 0)):
        other, first = row[mine[o]][np.argsort(word[mine[o]], kind="stable")], np.cumsum(df[o]) - df[o]
        r, w = row[mine[s]], word[mine[s]]
        rare = np.lexsort((df[o][w], r))
        r, w = r[rare], w[rare]
        have = np.bincount(r, minlength=n)
        rare = np.arange(len(r)) - (np.cumsum(have) - have)[r] <= (have - need)[r]
        r, w = r[rare], w[rare]
        for cut in cuts(df[o][w]):
            of, at = runs(first[w[cut]], df[o][w[cut]])
            x, y = r[cut][of], other[at]
            ok = size[x] <= size[y] if s == 0 else size[x] < size[y]
            x, y = x[ok], y[ok]
            found.append(distinct(x * n + n - 1 - y if s == 0 else y * n + n - 1 - x))
    pairs = distinct(np.concatenate(found))
    old, new = pairs // max(n, 1), n - 1 - pairs % max(n, 1)
    less = size[old] <= size[new]
    small, large = np.where(less, old, new), np.where(less, new, old)
    start, all_, shared = np.cumsum(met) - met, np.sort(row * len(keys) + word), np.zeros(len(old), "int64")
    for cut in cuts(met[small]):
        of, at = runs(start[small[cut]], met[small[cut]])
        asked = large[cut][of] * len(keys) + word[at]
        place = np.searchsorted(all_, asked)
        hit = all_[np.minimum(place, len(all_) - 1)] == asked
        shared[cut] = np.bincount(of[hit], minlength=len(small[cut]))
    near = shared / np.minimum(size[old], size[new]) >= bar
    old, new, shared = old[near], new[near], shared[near]
    return old, new, shared * 2.0 * shared / (size[old] + size[new])


def _equal(group: np.ndarray, side: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(old, new): rows of one group and code, the first of each side, the second of each side and so on."""
    order = np.lexsort((side, code, group))
    g, x = group[order], code[order]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1])])
    n, n_new = np.diff(np.r_[first, len(order)]), np.add.reduceat(side[order], first)
    k = np.minimum(n - n_new, n_new)
    return order[runs(first, k)[1]], order[runs(first + n - n_new, k)[1]]


def _aligned(rows: pa.Table, bar: float) -> list[pa.Array]:
    """document_id, old_no, new_no, old, new, same of whole documents' rows (document_id, side, number, text, text in lower case), sorted by document, side and number."""
    ids, side, no, text, low = (c.chunk(0) for c in rows.combine_chunks().columns)
    group, side = np.cumsum(starts(ids)), side.to_numpy()
    pair = np.full(len(ids), -1)
    old, new = _equal(group, side, pc.fill_null(_squashed(low).dictionary_encode().indices, -1).to_numpy())
    pair[old], pair[new] = new, old
    same = pair >= 0
    free = np.flatnonzero(pair < 0)
    old, new, weight = _near(group[free], side[free], *_letter_words(low.take(pa.array(free))), bar)
    old, new = free[old], free[new]
    # cut where all pairs before are before all pairs behind, so between documents too; what stands alone is taken
    part = np.flatnonzero((np.maximum.accumulate(new)[:-1] < np.minimum.accumulate(new[::-1])[::-1][1:]) & (old[:-1] < old[1:])) + 1
    first = np.r_[0, part][: len(old)]
    size = np.diff(np.r_[first, len(old)])
    one = first[size == 1]
    pair[old[one]], pair[new[one]] = new[one], old[one]
    for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        o, n = np.array(_best_chain(*(x[a : a + n].tolist() for x in (old, new, weight)))).T
        pair[o], pair[n] = n, o
    old, added = np.flatnonzero(side == 0), np.flatnonzero((side == 1) & (pair < 0))
    at = np.r_[old, np.full(len(added), -1)], np.r_[pair[old], added]
    one = np.where(at[0] < 0, at[1], at[0])
    old, new = (pa.array(x, mask=x < 0) for x in at)
    return [ids.take(pa.array(one)), no.take(old), no.take(new), text.take(old), text.take(new), pa.array(same[one])]


def letter_words(text: Column) -> Column:
    """``content_words`` without a digit."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?<![a-z0-9])([a-z]{3,}+)(?![0-9])"), F.lit(1))
    return F.array_except(found, F.array(*map(F.lit, tx.STOP_WORDS)))


def _letter_words(low: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``letter_words`` of texts in lower case: how many each has, and codes of them all, one text after the other."""
    raw, ends = _bytes(low)
    letter, digit = (raw >= 97) & (raw <= 122), (raw >= 48) & (raw <= 57)
    # words are runs of letters and digits within a text
    inside = np.r_[False, letter | digit, False]
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends] = True
    first = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    last = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    digits = np.r_[0, np.cumsum(digit, dtype="int64")]
    kept = (last - first > 2) & (digits[last] == digits[first])
    first, last = first[kept], last[kept]
    row, size = np.repeat(np.arange(len(low)), np.diff(ends))[first], last - first
    at = runs(first, size)[1]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype("int64")), pa.py_buffer(raw[at])]).dictionary_encode()
    stop = pc.is_in(words.dictionary, pa.array([w.encode() for w in tx.STOP_WORDS], pa.large_binary())).to_numpy(zero_copy_only=False)
    n, code = max(len(stop), 1), words.indices.to_numpy().astype("int64")
    kept = ~stop[code]
    once = distinct(row[kept] * n + code[kept])
    return np.bincount(once // n, minlength=len(low)), once % n


def _bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last ends; a null has none."""
    x = pc.fill_null(text, "").cast(pa.large_binary())
    ends = np.frombuffer(x.buffers()[1], "int64")[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2] or b"", "uint8")[ends[0] : ends[-1]], ends - ends[0]


#: ``tx.SPACE`` and the replacements of ``tx.squash``, for Python's strings.
_BLANK = re.compile(tx.SPACE.replace(r"\s", r" \t-\r") + "+")
_PLAIN = str.maketrans(tx.SQUASH_FROM, tx.SQUASH_TO)


def _squashed(low: pa.Array) -> pa.Array:
    """``tx.squash`` of texts in lower case.  Only those are rewritten that have two blanks, a blank other than a space, or a character that begins like one of its own."""
    raw, ends = _bytes(low)
    then = np.r_[raw[1:], np.uint8(0)][: len(raw)]
    odd = (raw < 32) | ((raw == 32) & (then == 32)) | ((raw == 0xC2) & ((then == 0xA0) | (then == 0x85))) | ((raw >= 0xE1) & (raw <= 0xE3))
    rows = np.unique(np.searchsorted(ends, np.flatnonzero(odd), "right") - 1)
    out = pc.utf8_trim(low, " ")
    if not len(rows):
        return out
    new = [None if x is None else _BLANK.sub(" ", x.translate(_PLAIN)).strip(" ") for x in low.take(pa.array(rows)).to_pylist()]
    mask = np.zeros(len(low), bool)
    mask[rows] = True
    return pc.replace_with_mask(out, pa.array(mask), pa.array(new, out.type))


def align_versions(rows: DataFrame, bar: float = DEFAULT.sentence_words) -> DataFrame:
    """(document_id, old_no, new_no, old, new): each sentence of an old version beside its restatement in the new one; null where there is none.

    rows: document_id (a number), side (0 old, 1 new), sentence_no, text.  Equal sentences are paired in order first.  Of the others those are candidates that share ``bar`` of the
    smaller one's content words, numbers aside.  A document's pairs are the set of candidates that keeps the
    order of both versions and shares most (shared words, weighted by how alike the two are).  Sentences without content words pair only when equal.

    Sentences are dealt out by document once and pass in order; a task holds those of one batch and of the document that goes on beyond it."""
    return _paired(rows, bar).drop("same")


def _paired(rows: DataFrame, bar: float) -> DataFrame:
    """``align_versions`` with ``same``: whether the two are equal but for blanks, case and typographic characters."""
    dealt = rows.select("document_id", F.col("side").cast("int").alias("side"), F.col("sentence_no").cast("long").alias("no"), "text").repartition("document_id").sortWithinPartitions("document_id", "side", "no")
    ready = dealt.select(F.col("document_id").cast("long").alias("document_id"), "side", "no", "text", F.lower("text").alias("low"))
    schema = pa.schema([("document_id", pa.int64()), ("old_no", pa.int64()), ("new_no", pa.int64()), ("old", pa.string()), ("new", pa.string()), ("same", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(_aligned(rows, bar), schema, strict=True)], schema=schema)

    out = ready.mapInArrow(run, "document_id long, old_no long, new_no long, old string, new string, same boolean")
    return out.withColumn("document_id", F.col("document_id").cast(rows.schema["document_id"].dataType))


def align_sentences(old: DataFrame, new: DataFrame, bar: float = DEFAULT.sentence_words) -> DataFrame:
    """``align_versions`` of two frames: document_id (a number), sentence_no, text."""
    return align_versions(_sides(old, new), bar)


def _sides(old: DataFrame, new: DataFrame) -> DataFrame:
    side = lambda d, s: d.select("document_id", F.lit(s).alias("side"), F.col("sentence_no").cast("long").alias("sentence_no"), "text")
    return side(old, 0).unionByName(side(new.withColumn("document_id", F.col("document_id").cast(old.schema["document_id"].dataType)), 1))


def version_changes(old: DataFrame, new: DataFrame, bar: float = DEFAULT.sentence_words) -> DataFrame:
    """``align_sentences`` with the kind of each change: what became of every sentence of the old version, and what is added."""
    return changes_of(_sides(old, new), bar)


def changes_of(rows: DataFrame, bar: float = DEFAULT.sentence_words) -> DataFrame:
    """``version_changes`` of both versions in one frame, as ``align_versions`` takes them."""
    return _paired(rows, bar).withColumn("change", _change(F.col("same"))).drop("same")


def classify_changes(pairs: DataFrame) -> DataFrame:
    """pairs (old, new) of sentences with ``change``: added, dropped, unchanged, delayed (later year), weakened (lower percentage), strengthened or restated."""
    o, n = F.col("old"), F.col("new")
    return pairs.withColumn("change", _change(o == n, tx.squash(o) == tx.squash(n)))


def _change(*same: Column) -> Column:
    """Kind of change of a row (old, new) that is unchanged where one of ``same`` holds.  Numbers are looked for only where the cases before leave it open."""
    year = lambda c: tx.let(F.regexp_extract(c, "(?=[12])" + YEAR, 1), lambda x: F.nullif(x, F.lit("")).cast("int"))
    number = lambda c: tx.let(F.regexp_extract(c, r"(\d[\d,]*(?:\.\d+)?)\s?(?:%|percent)", 1), lambda x: F.replace(F.nullif(x, F.lit("")), F.lit(","), F.lit("")).cast("double"))
    o, n = F.col("old"), F.col("new")
    share = lambda x: F.when(x["n"] < x["o"], "weakened").when(x["n"] > x["o"], "strengthened").otherwise("restated")
    return (
        F.when(o.isNull(), "added").when(n.isNull(), "dropped").when(reduce(Column.__or__, same), "unchanged").when(year(n) > year(o), "delayed")
        .otherwise(tx.let(F.struct(number(o).alias("o"), number(n).alias("n")), share))
    )


def restated_claims(claims: DataFrame, by: str) -> DataFrame:
    """(by, h, n_claims, n_documents): the same claim in several documents of one ``by``."""
    return claims.groupBy(by, F.xxhash64(tx.squash(F.col("text"))).alias("h")).agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct("document_id").alias("n_documents")).where("n_documents > 1")
