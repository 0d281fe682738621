"""Quotes, spans and regions of texts; offsets are characters from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..scratch import settled
from .matching import binned


def line_regions(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(document_id, line_no, start, end, text) of the lines of each text."""
    lines = docs.select(F.col(key).alias("document_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    before = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return lines.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))


def _shingle(words: Column, i: Column, n: int = 4) -> Column:
    return F.xxhash64(*(F.get(words, i + k) for k in range(n)))


def find_quotes(quotes: DataFrame, docs: DataFrame, quote_key: str = "item_id", doc_key: str = "doc_id") -> DataFrame:
    """(doc_key, quote_key): documents that contain each quote, typography, white space and case aside.

    The words inside a quote (without its first and last, which may be parts of words) stand in the text as they
    are: they are joined by a hash of up to four of them, and the exact test follows.  Quotes of one or two words
    are joined by the words of the texts that hold their longer word, found by its first three characters."""
    q = quotes.select(quote_key, tx.squash(F.col("text")).alias("q")).where("q <> ''").withColumn("__n", F.size(F.split("q", " ")))
    qw, dw = F.split("q", " "), F.col("__w")
    d = docs.select(doc_key, tx.squash(F.col("text")).alias("t")).withColumn("__w", F.split("t", " "))
    hashed = F.when(F.col("__k") == 1, _shingle(qw, F.lit(1), 1)).when(F.col("__k") == 2, _shingle(qw, F.lit(1), 2)).when(F.col("__k") == 3, _shingle(qw, F.lit(1), 3)).otherwise(_shingle(qw, F.lit(1), 4))
    keyed = q.where("__n >= 3").withColumn("__k", F.least(F.col("__n") - 2, F.lit(4))).withColumn("__h", hashed)
    last = F.size(dw) - 1
    hashes = lambda n: F.when(F.size(dw) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), last - n + 1), lambda i: _shingle(dw, i, n))))
    got = None
    for n in sorted(r["__k"] for r in keyed.select("__k").distinct().collect()):  # four at most
        wanted = keyed.where(F.col("__k") == n).select(quote_key, "q", "__h")
        cand = d.select(doc_key, F.explode(hashes(n)).alias("__h")).join(wanted, "__h").select(doc_key, quote_key, "q").distinct()
        hit = cand.join(d.select(doc_key, "t"), doc_key).where(F.col("t").contains(F.col("q"))).select(doc_key, quote_key)
        got = hit if got is None else got.unionByName(hit)
    short = q.where("__n < 3").withColumn("part", F.when(F.length(F.get(qw, F.lit(0))) >= F.length(F.coalesce(F.get(qw, F.lit(1)), F.lit(""))), F.get(qw, F.lit(0))).otherwise(F.get(qw, F.lit(1))))
    if got is None or not short.isEmpty():
        words = d.select(doc_key, F.explode(F.array_distinct(dw)).alias("w"))
        grams = words.select("w").distinct().where("w <> ''").select("w", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.substring(F.col("w"), i, n)))))).alias("g"))
        near = grams.join(short.withColumn("g", F.substring("part", 1, 3)), "g").where(F.col("w").contains(F.col("part"))).select("w", quote_key, "q").distinct()
        cand = words.join(near, "w").select(doc_key, quote_key, "q").distinct()
        hit = cand.join(d.select(doc_key, "t"), doc_key).where(F.col("t").contains(F.col("q"))).select(doc_key, quote_key)
        got = hit if got is None else got.unionByName(hit)
    return got.distinct()


def locate_quotes(pairs: DataFrame) -> DataFrame:
    """pairs (document_id, owner_id, quote, text) with start, end, found (the text's own words), occurrence.

    Forms of the quote are tried in order, each as it is, with typography made plain, then ignoring case; the first
    that occurs counts.  Of its occurrences, quotes of a document take, in the order of owner_id, the first that overlaps
    none taken before (the first of all where every one does).  Only quotes with several occurrences need that order: the
    places of a document's quotes are folded one after the other, without its text."""
    forms = tx.strip_quote_forms(F.col("quote"))

    def attempt(text: Column, needle: Column) -> Column:
        one = F.array(F.struct(tx.find_all(text, needle).alias("hits"), F.length(needle).alias("n")))
        return F.get(F.filter(one, lambda x: F.size(x["hits"]) > 0), F.lit(0))

    tries = []  # looked at in turn, none after the first that has a hit
    for i in range(4):
        form = F.get("__forms", F.lit(i))
        n = tx.normalise(form)
        tries += [attempt(F.col("text"), form), attempt(F.col("__p"), n), attempt(F.lower("__p"), F.lower(n))]
    # written once: the fold and the rows themselves read it, and each would find pairs and places anew
    hit = settled(pairs.withColumn("__p", tx.normalise(F.col("text"))).withColumn("__forms", forms).withColumn("__hit", F.coalesce(*tries)).drop("__p", "__forms"))
    row = F.struct("owner_id", F.col("__hit.hits").alias("hits"), F.col("__hit.n").alias("n"))
    spans = "array<struct<owner_id: bigint, start: int, end: int>>"

    def take(done: Column, x: Column) -> Column:
        free = F.filter(x["hits"], lambda h: ~F.exists(done, lambda t: (h < t["end"]) & (h + x["n"] > t["start"])))
        at = F.coalesce(F.get(free, F.lit(0)), F.get(x["hits"], F.lit(0)))
        return F.concat(done, F.array(F.struct(x["owner_id"].cast("bigint").alias("owner_id"), at.cast("int").alias("start"), (at + x["n"]).cast("int").alias("end"))))

    taken = hit.where("__hit is not null").groupBy("document_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    taken = taken.select(F.col("document_id").alias("__d"), F.explode(F.aggregate("rows", F.array().cast(spans), take)).alias("__s")).select("__d", F.col("__s.owner_id").alias("__o"), F.col("__s.start").alias("start"), F.col("__s.end").alias("end"))
    out = hit.join(taken, (F.col("document_id") == F.col("__d")) & (F.col("owner_id") == F.col("__o")), "left").drop("__d", "__o")
    out = out.withColumn("found", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    same = tx.find_all(F.col("text"), F.col("found"))
    occurrence = F.when(F.size(same) > 1, F.nullif(F.array_position(same, F.col("start")), F.lit(0)))
    return out.withColumn("occurrence", occurrence).drop("__hit")


def locate_region(spans: DataFrame, regions: DataFrame) -> DataFrame:
    """spans with the innermost labelled paragraph that holds each, and the prominence there.

    regions: document_id, kind, label, start, end, prominence.  A range join on document and bin."""
    containers = ("cautionary_note", "promo", "footnote", "quote")
    s = spans.withColumn("__bin", F.floor(F.col("start") / 1024))
    r = binned(regions.withColumnsRenamed({"start": "r_start", "end": "r_end"}).withColumn("start", F.col("r_start")).withColumn("end", F.col("r_end"))).drop("start", "end")
    inside = s.select("document_id", "owner_id", "start", "end", "__bin").join(r, ["document_id", "__bin"]).where("r_start <= start and end <= r_end")
    size = F.struct(F.col("r_end") - F.col("r_start"), F.col("r_start"), F.col("label"))
    para = (F.col("kind") == "paragraph") & F.col("label").isNotNull()
    best = inside.groupBy("document_id", "owner_id", "start", "end").agg(
        F.min_by(F.when(para, F.struct("label", "prominence")), F.when(para, size)).alias("p"),
        F.min_by(F.when(F.col("kind").isin(*containers), F.col("prominence")), F.when(F.col("kind").isin(*containers), size)).alias("c"),
    )
    return spans.join(best, ["document_id", "owner_id", "start", "end"], "left").withColumn("paragraph", F.col("p.label")).withColumn("prominence", F.coalesce("p.prominence", "c")).drop("p", "c")


def reanchor(spans: DataFrame) -> DataFrame:
    """spans (text, needle, start, end, context, occurrence, old_text) with new_start, new_end, method.

    Tried in order: the offsets still hold; a context that is unique; the given occurrence; a unique
    occurrence; the same ordinal as in the old text.  A context or occurrence that fails is final."""
    n = F.length("needle")
    hits = tx.find_all(F.col("text"), F.col("needle"))
    ctx = tx.find_all(F.col("text"), F.col("context"))
    rel = F.instr(F.col("context"), F.col("needle")) - 1
    old = tx.find_all(F.col("old_text"), F.col("needle"))
    got = lambda at, m: F.struct(at.cast("int").alias("new_start"), F.lit(m).alias("method"))
    has_ctx = F.coalesce(F.col("context"), F.lit("")) != ""
    exact = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("needle"))
    pick = (
        F.when(F.coalesce(exact, F.lit(False)), got(F.col("start"), "offset"))
        .when(has_ctx, F.when((F.size(ctx) == 1) & (rel >= 0), got(F.get(ctx, F.lit(0)) + rel, "context")))
        .when(F.col("occurrence") >= 1, F.when(F.col("occurrence") <= F.size("__hits"), got(F.get("__hits", F.col("occurrence") - 1), "occurrence")))
        .when(F.size("__hits") == 1, got(F.get("__hits", F.lit(0)), "unique"))
        .when((F.size("__hits") > 1) & (F.size("__old") == F.size("__hits")) & F.array_contains("__old", F.col("start")), got(F.get("__hits", (F.array_position("__old", F.col("start")) - 1).cast("int")), "same_occurrence"))
    )
    out = spans.withColumn("__hits", hits).withColumn("__old", F.coalesce(old, F.array().cast("array<int>"))).withColumn("__x", pick)
    return out.withColumn("new_start", F.col("__x.new_start")).withColumn("new_end", F.col("new_start") + n).withColumn("method", F.col("__x.method")).drop("__x", "__hits", "__old")


def span_report(spans: DataFrame) -> DataFrame:
    """spans (text, needle, context, occurrence) with ``reason`` where a span cannot be placed: not_found,
    context_not_unique, occurrence_too_high, ambiguous; null where it can."""
    hits, ctx = F.size(tx.find_all(F.col("text"), F.col("needle"))), F.size(tx.find_all(F.col("text"), F.col("context")))
    reason = (
        F.when(hits == 0, "not_found").when((F.coalesce(F.col("context"), F.lit("")) != "") & (ctx != 1), "context_not_unique")
        .when(F.col("occurrence") > hits, "occurrence_too_high").when((hits > 1) & F.col("occurrence").isNull() & (F.coalesce(F.col("context"), F.lit("")) == ""), "ambiguous")
    )
    return spans.withColumn("reason", reason)


def attach_orphans(signals: DataFrame, claim_spans: DataFrame) -> DataFrame:
    """signals (document_id, signal_id, start, end) without a claim with the first claim whose span holds theirs."""
    c = binned(claim_spans.select("document_id", "claim_id", "start", "end")).withColumnsRenamed({"start": "c_start", "end": "c_end"})
    s = signals.withColumn("__bin", F.floor(F.col("start") / 1024))
    hit = s.join(c, ["document_id", "__bin"]).where("c_start <= start and end <= c_end").groupBy("document_id", "signal_id").agg(F.min_by("claim_id", F.struct("c_start", "claim_id")).alias("claim_id"))
    return signals.join(hit, ["document_id", "signal_id"], "left")


def segments(marks: DataFrame) -> DataFrame:
    """(document_id, start, end, marks): the text cut at every mark's border, with the marks over each piece, longest first.

    marks: document_id, mark_id, start, end.  Pieces under no mark are left out."""
    cuts = marks.select("document_id", F.explode(F.array("start", "end")).alias("at")).distinct()
    pieces = cuts.withColumn("to", F.lead("at").over(Window.partitionBy("document_id").orderBy("at"))).where("to is not null")
    p = binned(pieces.withColumnsRenamed({"at": "start", "to": "end"})).withColumnsRenamed({"start": "at", "end": "to"})
    m = binned(marks)
    over = m.join(p, ["document_id", "__bin"]).where("start <= at and to <= end").select("document_id", "at", "to", "mark_id", (F.col("end") - F.col("start")).alias("n")).distinct()
    return over.groupBy("document_id", F.col("at").alias("start"), F.col("to").alias("end")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "mark_id"))), lambda x: x["mark_id"]).alias("marks"))


def place_signals(signals: DataFrame, claim_spans: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """signals (document_id, signal_id, claim_id, needle, text) with their places and tier: all hits inside their
    claim's spans (1), else the first in the paragraphs that hold those spans (2), else the first in the text (3).

    claim_spans: document_id, claim_id, start, end; regions: document_id, start, end (and kind) of paragraphs and containers."""
    hits = signals.select("document_id", "signal_id", "claim_id", F.length("needle").alias("n"), F.explode(tx.find_all(F.col("text"), F.col("needle"))).alias("start"))
    windows = claim_spans.select("document_id", "claim_id", F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.lit(1).alias("tier"))
    if regions is not None:
        r = binned(regions.select("document_id", "start", "end").distinct()).withColumnsRenamed({"start": "w_start", "end": "w_end"})
        held = claim_spans.withColumn("__bin", F.floor(F.col("start") / 1024)).join(r, ["document_id", "__bin"]).where("w_start <= start and end <= w_end")
        windows = windows.unionByName(held.select("document_id", "claim_id", "w_start", "w_end", F.lit(2).alias("tier")).distinct())
    near = hits.join(windows, ["document_id", "claim_id"]).where("w_start <= start and start + n <= w_end").groupBy("document_id", "signal_id", "n", "start").agg(F.min("tier").alias("tier"))
    every = hits.groupBy("document_id", "signal_id", "n").agg(F.min("start").alias("start")).withColumn("tier", F.lit(3))
    by = Window.partitionBy("document_id", "signal_id")
    ranked = near.unionByName(every.select(near.columns)).withColumn("best", F.min("tier").over(by)).where("tier = best").withColumn("k", F.row_number().over(by.orderBy("start")))
    return ranked.where("tier = 1 or k = 1").select("document_id", "signal_id", "start", (F.col("start") + F.col("n")).alias("end"), "tier")
