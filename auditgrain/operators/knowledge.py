"""Rulings, criteria and industry topics: term matching, placement and hold-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .automaton import term_hits

def mentions(docs: DataFrame, terms: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """(doc_key, term): terms that stand in each text as whole words, case aside; from one pass over the texts for all terms.

    No letter a-z or digit stands next to a term; a term without any may stand anywhere."""
    hits = term_hits(docs.select(doc_key, "text"), terms)
    seen = hits.select(doc_key, F.explode(F.array_distinct(F.transform("hits", lambda h: h["term"]))).alias("__t"))
    written = terms.select("term", F.trim("term").alias("__t")).distinct()
    return seen.join(written, "__t").select(doc_key, "term").distinct()


def topic_matches(docs: DataFrame, topics: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """A row for each document: (doc_key, topics array<struct<topic, seen, n_terms>>), all topics by name, with the terms seen, sorted.

    topics: topic, term.  They reach the driver (the automaton holds their terms anyway) and stand in the plan as one constant; neither
    texts nor hits are joined or shuffled."""
    rows = topics.where("term is not null").groupBy("topic").agg(F.array_sort(F.collect_set(F.trim("term"))).alias("terms")).orderBy("topic").toJSON().toLocalIterator()
    kind = f"array<struct<topic: {topics.schema['topic'].dataType.simpleString()}, terms: array<string>>>"
    known = F.from_json(F.lit("[" + ",".join(rows) + "]"), kind)
    hits = term_hits(docs.select(doc_key, "text"), topics.select("term"))
    seen = F.array_distinct(F.transform("hits", lambda h: h["term"]))
    each = lambda t: F.struct(t["topic"].alias("topic"), F.array_sort(F.array_intersect(t["terms"], seen)).alias("seen"), F.size(t["terms"]).alias("n_terms"))
    return hits.select(doc_key, F.transform(known, each).alias("topics"))


def topic_coverage(docs: DataFrame, topics: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """(doc_key, topic, seen, absent) for every document and topic: ``topic_matches`` with a row for each; seen is null where absent."""
    each = topic_matches(docs, topics, doc_key).select(doc_key, F.explode("topics").alias("t"))
    return each.select(doc_key, "t.topic", F.when(F.size("t.seen") > 0, F.col("t.seen")).alias("seen"), (F.size("t.seen") == 0).alias("absent"))


def excluded_rulings(docs: DataFrame, rulings: DataFrame, doc_key: str) -> DataFrame:
    """(doc_key, ruling_id): the rulings on each document's own url, which must not be used for it; all others may.

    docs: doc_key, url; rulings: ruling_id, adjudicated_url (one row for each url; null for none)."""
    own = docs.select(doc_key, tx.norm_url(F.col("url")).alias("u")).join(rulings.select("ruling_id", tx.norm_url(F.col("adjudicated_url")).alias("u")), "u")
    return own.select(doc_key, "ruling_id").distinct()


def hold_out(uses: DataFrame, docs: DataFrame, rulings: DataFrame, doc_key: str) -> DataFrame:
    """``uses`` (doc_key, ruling_id and more) without those of rulings on the document's own url.

    What is excluded is kept as pairs, never what is allowed: the cost is that of the uses, not of documents times rulings."""
    return uses.join(excluded_rulings(docs, rulings, doc_key), [doc_key, "ruling_id"], "left_anti")


def allowed_rulings(docs: DataFrame, rulings: DataFrame, doc_key: str) -> DataFrame:
    """(doc_key, ruling_id): every ruling beside every document, without those on the document's own url.

    The pairs are the result; they are made where they are written, from documents with the list of what is excluded, and are never shuffled."""
    own = excluded_rulings(docs, rulings, doc_key).groupBy(doc_key).agg(F.collect_set("ruling_id").alias("__own"))
    ids = rulings.select("ruling_id").distinct()
    return docs.select(doc_key).join(own, doc_key, "left").crossJoin(ids).where("__own is null or not array_contains(__own, ruling_id)").select(doc_key, "ruling_id")


def place_by_code(docs: DataFrame, entries: DataFrame, doc_key: str) -> DataFrame:
    """(doc_key, entry_id, tier): the entry with the document's code (1), else one that names it as a neighbour (2),
    and the entry for all industries (code '*', tier 3; of several the least id) always.

    docs: doc_key, code; entries: entry_id, code, also_codes (array)."""
    a = docs.join(entries.select("entry_id", "code"), "code").select(doc_key, "entry_id", F.lit(1).alias("tier"))
    b = docs.join(entries.select("entry_id", F.explode("also_codes").alias("code")), "code").select(doc_key, "entry_id", F.lit(2).alias("tier"))
    best = a.unionByName(b).withColumn("__r", F.row_number().over(Window.partitionBy(doc_key).orderBy("tier", "entry_id"))).where("__r = 1").drop("__r")
    general = entries.where("code = '*'").agg(F.min("entry_id").alias("entry_id"))  # one row
    every = docs.select(doc_key).distinct().crossJoin(F.broadcast(general)).where("entry_id is not null")
    return best.unionByName(every.select(doc_key, "entry_id", F.lit(3).alias("tier")))


def place_by_label(docs: DataFrame, aliases: DataFrame, doc_key: str) -> DataFrame:
    """(doc_key, entry_id, alias): the entry whose longest alias holds, or is held by, the document's label.

    docs: doc_key, label; aliases: entry_id, alias.  Labels are few, so distinct ones are matched."""
    labels = docs.select("label").distinct().withColumn("f", tx.fold_label(F.col("label"))).where("f <> ''")
    a = aliases.withColumn("a", tx.fold_label(F.col("alias"))).where("a <> ''")
    # who holds the other also holds its first three characters: an equality join, the exact test follows
    head = lambda c: F.substring(c, 1, 3)
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.substring(c, i, n)))))
    f, alias = F.col("f"), F.col("a")
    down = labels.withColumn("g", F.explode(grams(f))).join(a.withColumn("g", head(alias)), "g").where(f.contains(alias))
    up = labels.withColumn("g", head(f)).join(a.withColumn("g", F.explode(grams(alias))), "g").where(alias.contains(f))
    cols = ["label", "entry_id", "alias", "a"]
    hit = down.select(cols).unionByName(up.select(cols)).distinct()
    best = hit.groupBy("label").agg(F.max_by(F.struct("entry_id", "alias"), F.struct(F.length("a"), F.col("a"), F.col("entry_id"))).alias("x"))
    return docs.join(best, "label").select(doc_key, "x.entry_id", "x.alias")


def match_knowledge(claims: DataFrame, store: DataFrame) -> DataFrame:
    """(claim key, entry_id, same_company): entries of which a term stands in the claim and that apply to its type.

    claims: claim_id, text, type, company; store: entry_id, term (one row each), applies_to (array), company."""
    hit = mentions(claims, store.select("term").distinct(), "claim_id").join(store, "term")
    c = claims.select("claim_id", "type", F.col("company").alias("claim_company"))
    out = hit.join(c, "claim_id").where((F.size("applies_to") == 0) | F.array_contains("applies_to", F.col("type")))
    same = tx.company_slug(F.col("company")) == tx.company_slug(F.col("claim_company"))
    return out.groupBy("claim_id", "entry_id").agg(F.max(F.coalesce(same, F.lit(False))).alias("same_company"))


def store_inventory(store: DataFrame) -> DataFrame:
    return store.groupBy("store").agg(F.count(F.lit(1)).alias("entries"), F.count_if("verified").alias("verified"), F.count_if(F.coalesce(F.col("quote"), F.lit("")) == "").alias("name_only"))


def store_violations(store: DataFrame) -> DataFrame:
    """(entry_id, rule): id form, date form, web url, and verified entries without a quote or a method."""
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("entry_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,63}$"), F.lit(False)), "id"),
        F.when(F.col("date").isNotNull() & F.try_to_date("date", "yyyy-MM-dd").isNull(), "date"), F.when(F.col("url").isNotNull() & ~tx.is_web_url(F.col("url")), "url"),
        F.when(F.col("verified") & (F.coalesce(F.col("quote"), F.lit("")) == ""), "verified_without_quote"),
        F.when(F.col("verified") & (F.coalesce(F.col("method"), F.lit("unverified")) == "unverified"), "verified_without_method"),
    ))
    return store.select("entry_id", F.explode(rules).alias("rule"))


def code_violations(entries: DataFrame) -> DataFrame:
    """Codes that more than one entry names."""
    codes = entries.select("entry_id", F.explode(F.concat(F.array("code"), "also_codes")).alias("code")).distinct()
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
