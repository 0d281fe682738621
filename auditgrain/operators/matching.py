"""Overlap joins, one-to-one matching and comparison of two analyses."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import DEFAULT
from ..functions import text as tx
from ..scratch import settled
from .wordsets import cuts, shared_words, starts, whole_groups

BIN = 1024


def binned(df: DataFrame, name: str = "__bin", size: int = BIN) -> DataFrame:
    """df (start, end) with one row for each ``size``-character bin it touches: an equality key for range joins."""
    last = F.greatest(F.col("end") - 1, F.col("start"))
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(last / size))))


def overlap_pairs(a: DataFrame, b: DataFrame, threshold: float = DEFAULT.overlap) -> DataFrame:
    """(document_id, a_id, b_id, share): entities whose spans overlap by ``threshold`` of the shorter span, at best.

    a and b: document_id, owner_id, start, end.  Joined by document and bin, never by document alone."""
    x = binned(a.select("document_id", F.col("owner_id").alias("a_id"), "start", "end")).withColumnsRenamed({"start": "s1", "end": "e1"})
    y = binned(b.select("document_id", F.col("owner_id").alias("b_id"), "start", "end")).withColumnsRenamed({"start": "s2", "end": "e2"})
    share = tx.overlap_share(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    hit = x.join(y, ["document_id", "__bin"]).where((F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")))
    return hit.groupBy("document_id", "a_id", "b_id").agg(F.max(share).alias("share")).where(F.col("share") >= threshold)


#: Pairs of a group up to which one task streams them; larger groups are matched in rounds.
GROUP = 200_000


def greedy_match(pairs: DataFrame, order: list[Column], left: list[str], right: list[str], group_rows: int = GROUP) -> DataFrame:
    """One-to-one pairs, best first: a pair is taken when neither of its sides has been.

    ``left`` and ``right`` are the keys of the sides; what they share (the document) is the group.  ``order`` must end in keys.

    Groups of at most ``group_rows`` pairs stream through one task each, sorted by Spark; the task holds the sides taken so far, never the
    pairs.  Larger groups are matched in rounds over all tasks: a pair that is the best one of both its sides is what the sequential
    loop takes too, whatever comes before it, so all such pairs are taken at once and pairs with a side taken go.  Rounds end when
    no pair is left.  Where a round removes less than a tenth (a long chain, in which each pair waits for the one before) or few are left,
    the rest streams."""
    group = [c for c in left if c in right]
    pairs = settled(pairs)
    if group:
        large = settled(pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > group_rows).select(*group))
        if not large.head(1):
            return _stream(pairs, order, left, right)
        same = [F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}")) for c in group]
        split = lambda how: pairs.alias("p").join(large.alias("l"), same, how)
        return _stream(split("left_anti"), order, left, right).unionByName(_rounds(split("left_semi"), order, left, right, group_rows))
    return _rounds(pairs, order, left, right, group_rows) if pairs.count() > group_rows else _stream(pairs, order, left, right)


def _rounds(pairs: DataFrame, order: list[Column], left: list[str], right: list[str], few: int) -> DataFrame:
    names = pairs.columns
    side = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    # a number that rises in the given order: partitions of a total sort come one after the other
    ranked = settled(pairs.orderBy(*order).withColumn("__r", F.monotonically_increasing_id()))
    edges = ranked.select("__r", side(left).alias("__x"), side(right).alias("__y"))
    n, taken = edges.count(), []
    while n > few:
        best = [edges.groupBy(s).agg(F.min("__r").alias("__r")) for s in ("__x", "__y")]
        took = settled(best[0].join(best[1], "__r"))
        taken.append(took.select("__r"))
        edges = settled(edges.join(took.select("__x"), "__x", "left_anti").join(took.select("__y"), "__y", "left_anti"))
        before, n = n, edges.count()
        if n > 0.9 * before:
            break
    rest = _stream(ranked.join(edges.select("__r"), "__r", "left_semi"), [F.col("__r")], left, right)
    if not taken:
        return rest.select(names)
    return ranked.join(reduce(DataFrame.union, taken), "__r", "left_semi").unionByName(rest).select(names)


def _stream(pairs: DataFrame, order: list[Column], left: list[str], right: list[str]) -> DataFrame:
    group = [c for c in left if c in right]
    own = [[c for c in side if c not in group] for side in (left, right)]
    names = pairs.columns
    dealt = pairs.repartition(*group) if group else pairs.repartition(1)
    keys = F.struct(*group) if group else F.struct(F.lit(1))
    ready = dealt.withColumn("__g", F.to_json(keys, {"ignoreNullFields": "false"})).sortWithinPartitions(*group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = None, (set(), set())
        for b in batches:
            sides = [list(zip(*(b.column(c).to_pylist() for c in side), strict=True)) if side else [()] * b.num_rows for side in own]
            keep = []
            for g, x, y in zip(b.column("__g").to_pylist(), *sides, strict=True):
                if g != now:
                    now, used = g, (set(), set())
                fresh = x not in used[0] and y not in used[1]
                if fresh:
                    used[0].add(x)
                    used[1].add(y)
                keep.append(fresh)
            yield b.select(names).filter(pa.array(keep, pa.bool_()))

    return ready.mapInArrow(run, pairs.schema)


def match_signals(live: DataFrame, ref: DataFrame, threshold: float = DEFAULT.overlap) -> DataFrame:
    """(document_id, live_id, ref_id, how): signals of one kind matched one to one, best first.

    live and ref: document_id, id, kind, level, claim_ids (array), spans (array<struct<start, end>>).  First by the share
    of overlap of their best spans (span, at ``threshold`` or more), then two of the document's level, or two
    that share a claim (claim)."""
    ranges = lambda d, n: d.select("document_id", "kind", F.col("id").alias(n), F.explode("spans").alias("s")).select("document_id", "kind", n, "s.start", "s.end")
    a = binned(ranges(live, "live_id")).withColumnsRenamed({"start": "s1", "end": "e1"})
    b = binned(ranges(ref, "ref_id")).withColumnsRenamed({"start": "s2", "end": "e2"})
    key = ["document_id", "live_id", "ref_id"]
    share = tx.overlap_share(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    spans = a.join(b, ["document_id", "kind", "__bin"]).where("s1 < e2 and s2 < e1").groupBy(key).agg(F.max(share).alias("share")).where(F.col("share") >= threshold).withColumn("way", F.lit(0))
    doc = lambda d, n: d.where("level = 'document'").select("document_id", "kind", F.col("id").alias(n))
    claim = lambda d, n: d.select("document_id", "kind", F.col("id").alias(n), F.explode("claim_ids").alias("claim_id"))
    near = doc(live, "live_id").join(doc(ref, "ref_id"), ["document_id", "kind"]).select(key).unionByName(claim(live, "live_id").join(claim(ref, "ref_id"), ["document_id", "kind", "claim_id"]).select(key)).distinct()
    pairs = spans.unionByName(near.join(spans, key, "left_anti").select(*key, F.lit(0.0).alias("share"), F.lit(1).alias("way")))
    got = greedy_match(pairs, [F.col("way"), F.desc("share"), F.col("live_id"), F.col("ref_id")], ["document_id", "live_id"], ["document_id", "ref_id"])
    return got.select(*key, F.when(F.col("way") == 0, "span").otherwise("claim").alias("how"))


def missed_extra(live: DataFrame, ref: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """(key, side): reference rows that nothing matches (missed) and live rows that match nothing (extra)."""
    m = ref.join(matches.select(*(F.col(f"ref_{k}").alias(k) for k in key)), key, "left_anti").select(*key, F.lit("missed").alias("side"))
    e = live.join(matches.select(*(F.col(f"live_{k}").alias(k) for k in key)), key, "left_anti").select(*key, F.lit("extra").alias("side"))
    return m.unionByName(e)


def compare_scores(live: DataFrame, ref: DataFrame, key: list[str], line: float = DEFAULT.score_line) -> DataFrame:
    """Reference scores beside live ones: difference, and whether they are on different sides of ``line``; unscored rows stay."""
    a = live.select(*key, F.col("score").alias("live"))
    out = ref.select(*key, F.col("score").alias("ref")).join(a, key, "left")
    return out.withColumn("diff", F.abs(F.col("live") - F.col("ref"))).withColumn("crosses", (F.col("live") >= line) != (F.col("ref") >= line))


def agreement(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number of pairs, mean absolute difference, pairs across the line, unscored ones."""
    return pairs.groupBy(*(keys or [])).agg(F.count("live").alias("n"), F.avg("diff").alias("mae"), F.count_if("crosses").alias("crossing"), F.count_if(F.col("live").isNull()).alias("unscored"))


def formula_report(rows: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Mean and largest error of a formula against recorded values, its bias, and the share within 0.10."""
    d = F.col(ours) - F.col(theirs)
    return rows.agg(F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.max(F.abs(d)).alias("worst"), F.avg((F.abs(d) <= 0.1 + 1e-9).cast("double")).alias("within"))


def tag_overlap(pairs: DataFrame, a: str, b: str) -> DataFrame:
    size = lambda x: F.coalesce(F.sum(F.size(x)), F.lit(0))
    return pairs.agg(size(F.array_intersect(a, b)).alias("both"), size(F.array_except(a, b)).alias("only_left"), size(F.array_except(b, a)).alias("only_right"))


def match_quality(matches: DataFrame, live: DataFrame, ref: DataFrame) -> DataFrame:
    """Recall, precision and the share of matches of the same type."""
    m = matches.agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("live_type") == F.col("ref_type")).alias("same_type"))
    n = live.agg(F.count(F.lit(1)).alias("n_live")).crossJoin(ref.agg(F.count(F.lit(1)).alias("n_ref")))  # one row each
    return m.crossJoin(n).select("matched", F.try_divide("matched", "n_ref").alias("recall"), F.try_divide("matched", "n_live").alias("precision"), F.try_divide("same_type", "matched").alias("type_agreement"))


def compare_links(live: DataFrame, ref: DataFrame) -> DataFrame:
    """For each reference (document, claim, relation): found at all, and found from one of the same urls."""
    key = ["document_id", "claim_id", "relation"]
    a = live.groupBy(key).agg(F.collect_set("url").alias("live_urls"))
    b = ref.groupBy(key).agg(F.collect_set("url").alias("ref_urls"))
    return b.join(a, key, "left").select(*key, F.col("live_urls").isNotNull().alias("found"), F.coalesce(F.arrays_overlap("live_urls", "ref_urls"), F.lit(False)).alias("same_url"))


def compare_sources(live: DataFrame, ref: DataFrame, key: list[str]) -> DataFrame:
    """Hosts of reference sources, archive prefix off, that live sources use too."""
    host = lambda c: tx.host_of(F.regexp_replace(c, r"^https?://[^/]*archive[^/]*/web/[^/]*/", ""))
    a = live.select(*key, host(F.col("url")).alias("host")).distinct().withColumn("hit", F.lit(1))
    b = ref.select(*key, host(F.col("url")).alias("host")).distinct()
    return b.join(a, [*key, "host"], "left").groupBy(key).agg(F.count(F.lit(1)).alias("n_hosts"), F.count("hit").alias("n_shared"))


#: Rows of a word up to which they meet in one place.
SLICE = 512


#: Cards of a document up to which one task compares them all; those of a larger one meet on their rare words.
CARDS = 256
#: Words of cards that are compared in one go, but for those of a single document.
WORDS = 1 << 20


def word_pairs(live: DataFrame, ref: DataFrame, bar: float = DEFAULT.card_words, slices: int = 32) -> DataFrame:
    """(document_id, ref_id, live_id, overlap): shared words over the smaller word set, at ``bar`` or more.

    live and ref: document_id, id, words (array of distinct words).  Cards are dealt out by document once, their words in one string, and a
    task counts what each two of a document share.  Documents of more than CARDS cards, of both sides, are not held by a task: their
    cards meet on rare words, in slices of ``slices`` at most (``_by_rare_words``)."""
    n = live.select("document_id").unionByName(ref.select("document_id")).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    large = settled(n.where((F.col("n") > CARDS) & F.col("document_id").isNotNull()).select("document_id"))
    if not large.head(1):
        return _by_document(live, ref, bar)
    part = lambda how: [d.join(large, "document_id", how) for d in (live, ref)]
    return _by_document(*part("left_anti"), bar).unionByName(_by_rare_words(*part("left_semi"), bar, slices))


def _by_document(live: DataFrame, ref: DataFrame, bar: float) -> DataFrame:
    ids = {n: d.schema["id"].dataType for n, d in (("live_id", live), ("ref_id", ref))}

    def side(d: DataFrame, name: str) -> DataFrame:
        put = [F.col("id").alias(n) if n == name else F.lit(None).cast(kind).alias(n) for n, kind in ids.items()]
        # a string takes a third of an array; words that it cannot keep apart stay an array
        one, words = d.where(F.size("words") > 0).select("document_id", F.lit(name == "live_id").alias("live"), *put, F.array_distinct("words").alias("words")), F.col("words")
        packed = one.withColumn("packed", F.array_join("words", "\0"))
        kept = F.length("packed") - F.length(F.replace("packed", F.lit("\0"), F.lit(""))) == F.size("words") - 1
        return packed.select("document_id", "live", *ids, F.when(kept, F.col("packed")).alias("packed"), F.when(~kept, words).alias("words"))

    dealt = side(live, "live_id").unionByName(side(ref, "ref_id")).where("document_id is not null").repartition("document_id").sortWithinPartitions("document_id")
    fields = {f.name: f.dataType for f in dealt.schema}
    schema = StructType([StructField(n, fields[n]) for n in ("document_id", "ref_id", "live_id")] + [StructField("overlap", DoubleType())])

    def compared(rows: pa.Table) -> pa.RecordBatch:
        ids, live, live_id, ref_id, packed, words = (c.chunk(0) for c in rows.combine_chunks().columns)
        lists = pc.coalesce(words, pc.split_pattern(packed, "\0").cast(words.type))
        size = pc.list_value_length(lists).to_numpy().astype("int64")
        word = pc.fill_null(lists.flatten().dictionary_encode().indices, -1).to_numpy().astype("int64")
        x, y, n = shared_words(np.cumsum(starts(ids)) - 1, live.to_numpy(zero_copy_only=False).astype("int64"), size, word)
        share = n / np.minimum(size[x], size[y])
        near = share >= bar
        x, y = pa.array(x[near]), pa.array(y[near])
        return pa.RecordBatch.from_arrays([ids.take(x), ref_id.take(x), live_id.take(y), pa.array(share[near])], ["document_id", "ref_id", "live_id", "overlap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches):
            begin = np.flatnonzero(starts(rows.column("document_id").combine_chunks()))
            size = pc.coalesce(pc.list_value_length(rows.column("words")), pc.count_substring(rows.column("packed"), "\0")).to_numpy() + 1
            ends = np.r_[begin, len(rows)].tolist()
            for part in cuts(np.add.reduceat(size, begin), WORDS):
                yield compared(rows.slice(ends[part.start], ends[part.stop] - ends[part.start]))

    return dealt.mapInArrow(run, schema)


def _by_rare_words(live: DataFrame, ref: DataFrame, bar: float, slices: int) -> DataFrame:
    """``word_pairs`` of cards that meet on rare words.

    Two sets with that overlap share one of the rarest
    n - ceil(bar * n) + 1 words of the smaller one, so candidates meet on those only (each side may be
    the smaller one), and the sets are compared once for each pair.  A word of more than SLICE rows is
    dealt out in slices of one side, ``slices`` at most; only such a word's rows of the other side are repeated."""
    def side(d: DataFrame, name: str) -> DataFrame:
        return d.select("document_id", F.col("id").alias(name), F.array_distinct("words").alias("words"), F.size(F.array_distinct("words")).alias("n")).where("n > 0")

    a, b = side(live, "live_id"), side(ref, "ref_id")
    both = a.select("document_id", F.explode("words").alias("w")).unionByName(b.select("document_id", F.explode("words").alias("w")))
    freq = both.groupBy("document_id", "w").agg(F.count(F.lit(1)).alias("df"))
    rare = F.slice(F.array_sort("x"), 1, F.col("n") - F.ceil(F.lit(bar) * F.col("n") - 1e-9).cast("int") + 1)

    def worded(d: DataFrame, name: str) -> DataFrame:
        return d.select("document_id", name, "n", F.explode("words").alias("w")).join(freq, ["document_id", "w"])

    def prefix(d: DataFrame, name: str) -> DataFrame:
        return worded(d, name).groupBy("document_id", name, "n").agg(F.collect_list(F.struct("df", "w")).alias("x")).select("document_id", name, "n", F.explode(rare).alias("x")).select("document_id", name, "n", "x.*")

    parts = F.greatest(F.lit(1), F.least(F.lit(slices), F.ceil(F.col("df") / SLICE).cast("int")))

    def meet(small: DataFrame, other: DataFrame, s: str, o: str, cond: str) -> DataFrame:
        few = prefix(small, s).select("document_id", s, F.col("n").alias("n1"), "w", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        all_ = worded(other, o).select("document_id", o, F.col("n").alias("n2"), "w", F.pmod(F.xxhash64(o), parts).cast("int").alias("part"))
        return few.join(all_, ["document_id", "w", "part"]).where(cond).select("document_id", "ref_id", "live_id")

    cand = meet(a, b, "live_id", "ref_id", "n1 <= n2").unionByName(meet(b, a, "ref_id", "live_id", "n1 < n2")).distinct()
    pairs = cand.join(a.select("document_id", "live_id", F.col("words").alias("x")), ["document_id", "live_id"]).join(b.select("document_id", "ref_id", F.col("words").alias("y")), ["document_id", "ref_id"])
    overlap = F.size(F.array_intersect("x", "y")) / F.least(F.size("x"), F.size("y"))
    return pairs.select("document_id", "ref_id", "live_id", overlap.alias("overlap")).where(F.col("overlap") >= bar)


def pair_by_words(live: DataFrame, ref: DataFrame, bar: float = DEFAULT.card_words) -> DataFrame:
    """(document_id, ref_id, live_id, overlap): each reference, in order of its id, with the free live row of most overlap."""
    return greedy_match(word_pairs(live, ref, bar), [F.col("ref_id"), F.desc("overlap"), F.col("live_id")], ["document_id", "ref_id"], ["document_id", "live_id"])


def align_ids(live: DataFrame, matches: DataFrame, key: list[str], ref: DataFrame) -> DataFrame:
    """live rows with ``new_id``: the matched reference's number, or the next ones after its highest.

    live: key, id; matches: key, live_id, ref_id; ref: key, id (numbers)."""
    top = ref.groupBy(key).agg(F.max("id").alias("__top"))
    out = live.join(matches.select(*key, F.col("live_id").alias("id"), "ref_id"), [*key, "id"], "left").join(top, key, "left")
    free = F.row_number().over(Window.partitionBy(*key, F.col("ref_id").isNull()).orderBy("id"))
    return out.withColumn("new_id", F.coalesce("ref_id", F.coalesce("__top", F.lit(0)) + free)).drop("__top", "ref_id")


def compare_summaries(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Mean absolute difference of two headers' numbers (key, profile, score)."""
    return a.select(*key, "profile", F.col("score").alias("x")).join(b.select(*key, "profile", F.col("score").alias("y")), [*key, "profile"]).groupBy(key).agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def compare_contradictions(live: DataFrame, ref: DataFrame, key: list[str]) -> DataFrame:
    """(key, side) of contradicted rows: in both, only live, only reference."""
    a, b = (x.where("relation like 'contradicts%'").select(key).distinct() for x in (live, ref))
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), key, "full")
    return both.select(*key, F.when(F.col("l").isNull(), "missed").when(F.col("r").isNull(), "extra").otherwise("agreed").alias("side"))


def round_trip_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): rows only in one, or with different contents."""
    rest = [c for c in a.columns if c not in keys]
    h = lambda d, n: d.select(*keys, F.xxhash64(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias(n))
    out = h(a, "x").join(h(b, "y"), keys, "full").where(~F.col("x").eqNullSafe(F.col("y")))
    return out.select(*keys, F.when(F.col("y").isNull(), "only_left").when(F.col("x").isNull(), "only_right").otherwise("different").alias("side"))


def new_evidence(found: DataFrame, prior: DataFrame) -> DataFrame:
    """Found evidence once for each (document, url, quote), without what earlier stages had."""
    key = lambda d: d.withColumn("__u", tx.norm_url(F.col("url"))).withColumn("__q", tx.squash(F.col("quote")))
    k = ["document_id", "__u", "__q"]
    first = F.row_number().over(Window.partitionBy(*k).orderBy("evidence_id"))
    return key(found).withColumn("__n", first).where("__n = 1").join(key(prior).select(k).distinct(), k, "left_anti").drop("__u", "__q", "__n")


def verify_quotes(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """evidence (url, quote) with ``outcome``: verified, absent or unreadable (no page).

    A quote is looked for in every page of its url (several captures may have it); the best outcome counts."""
    key = ["__u", "quote"]
    asked = evidence.withColumn("__u", tx.norm_url(F.col("url")))
    text = pages.select(tx.norm_url(F.col("url")).alias("__u"), F.col("text").alias("__t")).where("__t is not null")
    seen = asked.select(key).distinct().join(text, "__u").groupBy(key).agg(F.max(F.coalesce(tx.contains_quote(F.col("__t"), F.col("quote")), F.lit(False))).alias("__hit"))
    a, b = asked.alias("a"), seen.alias("b")
    out = a.join(b, (F.col("a.__u") == F.col("b.__u")) & F.col("a.quote").eqNullSafe(F.col("b.quote")), "left").select("a.*", "b.__hit")
    return out.withColumn("outcome", F.when(F.col("__hit").isNull(), "unreadable").when(F.col("__hit"), "verified").otherwise("absent")).drop("__u", "__hit")


def integrity_report(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Sources, outcomes of quote checks, downgraded links and repeated items."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    return evidence.groupBy(keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("sources"), n("verified"), n("absent"), n("unreadable"),
        F.count_if("downgraded").alias("downgraded"), (F.count(F.lit(1)) - F.count_distinct("url", "quote")).alias("duplicates"),
    )
