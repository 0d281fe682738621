"""From documents to companies: dates, recency, the roll-up and its trend over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, AuditConfig
from .summary import contributions, lehmer, weight
from .verdict import clamp01, rounded


def archive_stamp(url: Column) -> Column:
    """Date of an archive capture from its URL, null without one."""
    return F.try_to_date(F.nullif(F.regexp_extract(url, r"/web/(\d{8})\d*(?:id_)?/", 1), F.lit("")), "yyyyMMdd")


def document_date(url: Column, archive_url: Column, retrieved: Column, gap_days: int = DEFAULT.archive_gap_days) -> Column:
    """(date, basis): the capture where it is ``gap_days`` older than the retrieval, else the retrieval."""
    stamp = F.coalesce(archive_stamp(archive_url), archive_stamp(url))
    got = F.when(F.trim(retrieved).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim(retrieved), "yyyy-MM-dd"))
    old = stamp.isNotNull() & (got.isNull() | (F.datediff(got, stamp) >= gap_days))
    return F.struct(F.when(old, stamp).otherwise(got).alias("date"), F.when(old, "archive").when(got.isNotNull(), "retrieved").otherwise("unknown").alias("basis"))


def recency(date: Column, newest: Column, halflife: float = DEFAULT.halflife_days, undated: float = DEFAULT.undated_recency) -> Column:
    """Half for every ``halflife`` days before the company's newest document; never zero."""
    return F.when(date.isNull(), undated).otherwise(F.pow(F.lit(0.5), F.greatest(F.datediff(newest, date), F.lit(0)) / halflife))


def with_recency(docs: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """docs (company_id, doc_date) with ``recency``; the newest date is a small aggregate joined back."""
    newest = docs.groupBy("company_id").agg(F.max("doc_date").alias("newest"))
    return docs.join(newest, "company_id").withColumn("recency", recency(F.col("doc_date"), F.col("newest"), config.halflife_days, config.undated_recency)).drop("newest")


def company_profile(docs: DataFrame, header: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """(company_id, profile, score, confidence): the headers of a company's documents, recency as prominence."""
    rows = with_recency(docs, config).join(header.select("document_id", "profile", "score", "confidence"), "document_id")
    return lehmer(rows.withColumn("prominence", F.col("recency")), ["company_id", "profile"], config.power, config.round_stages)


def document_shares(docs: DataFrame, header: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """Each document's share of its company's headline."""
    rows = with_recency(docs, config).join(header.where("profile = 'headline'").select("document_id", "score", "confidence"), "document_id")
    return contributions(rows.withColumn("prominence", F.col("recency")).withColumn("target", F.col("document_id").cast("string")), ["company_id"], config.power)


def trend(docs: DataFrame, header: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """Movement of each company's headline over its dated documents, with its own confidence.

    docs: company_id, document_id, doc_date; header: document_id, score, confidence of the headline."""
    points = docs.join(header.select("document_id", "score", "confidence"), "document_id")
    by = Window.partitionBy("company_id").orderBy("doc_date", "document_id")
    dated = points.where("doc_date is not null").withColumn("step", F.abs(F.col("score") - F.lag("score").over(by)))
    at = F.struct("doc_date", "document_id")
    pick = lambda f, c: f(c, at)
    ends = dated.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("points"), F.sum("step").alias("gross"),
        *(pick(f, c).alias(f"{n}_{c}") for f, n in ((F.min_by, "first"), (F.max_by, "last")) for c in ("score", "confidence", "doc_date", "document_id")),
    )
    two = F.col("points") >= 2
    change = rounded(F.col("last_score") - F.col("first_score"), 2)
    span = F.datediff("last_doc_date", "first_doc_date")
    consistency = F.when(F.col("gross") <= 1e-9, 1.0).otherwise(F.least(F.lit(1.0), F.abs("change") / F.col("gross")))
    worth = F.least(F.lit(config.points_cap), config.two_points + config.point_gain * (F.col("points") - 2))
    out = docs.select("company_id").distinct().join(ends, "company_id", "left").withColumn("points", F.coalesce("points", F.lit(0)))
    return (
        out.withColumn("change", F.when(two, change)).withColumn("span_days", F.when(two, span))
        .withColumn("per_year", F.when(F.col("span_days") > 0, rounded(F.col("change") * 365.25 / F.col("span_days"), 2)))
        .withColumn("consistency", F.when(two, consistency))
        .withColumn("direction", F.when(~two, "undetermined").when(F.abs("change") < config.epsilon, "steady").when(F.col("change") > 0, "worsening").otherwise("improving"))
        .withColumn("confidence", F.when(two, clamp01(F.least(worth, "first_confidence", "last_confidence") * F.col("consistency"))).otherwise(0.0))
    )


def dimension_change(docs: DataFrame, header: DataFrame) -> DataFrame:
    """Change of every header number between a company's first and last dated document (two or more)."""
    at = F.struct("doc_date", "document_id")
    dated = docs.where("doc_date is not null")
    ends = dated.groupBy("company_id").agg(F.min_by("document_id", at).alias("first_id"), F.max_by("document_id", at).alias("last_id")).where("first_id <> last_id")
    both = ends.select("company_id", F.explode(F.array(F.struct(F.col("first_id").alias("document_id"), F.lit(False).alias("last")), F.struct(F.col("last_id").alias("document_id"), F.lit(True).alias("last")))).alias("x"))
    got = both.select("company_id", "x.*").join(header.select("document_id", "profile", "score"), "document_id")  # the header is made and read once
    score = lambda when: F.max(F.when(when, F.col("score")))
    pairs = got.groupBy("company_id", "profile").agg(F.bool_or("last").alias("there"), score(F.col("last")).alias("b"), score(~F.col("last")).alias("a")).where("there")
    return pairs.select("company_id", "profile", rounded(F.col("b") - F.coalesce("a", F.lit(0.0)), 2).alias("change"))


def company_findings(rows: DataFrame, docs: DataFrame, k: int = DEFAULT.company_issues, config: AuditConfig = DEFAULT) -> DataFrame:
    """The ``k`` worst findings over a company's documents; each weighs by its document's recency too.

    Severities that differ in their last bits only, by the order of their factors, are equal: the score decides."""
    found = rows.join(with_recency(docs, config).select("company_id", "document_id", "recency"), "document_id").withColumn("prominence", F.col("prominence") * F.col("recency"))
    found = found.withColumn("severity", F.col("score") * weight(F.col("prominence"), F.col("confidence")))
    by = Window.partitionBy("company_id").orderBy(F.round("severity", 9).desc(), F.desc("score"), "document_id", "target")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def company_credit(verdicts: DataFrame, docs: DataFrame, k: int = DEFAULT.credit, config: AuditConfig = DEFAULT) -> DataFrame:
    rows = verdicts.where("category = 'supported'").join(with_recency(docs, config).select("company_id", "document_id", "recency"), "document_id")
    w = weight(F.col("prominence") * F.col("recency"), F.col("confidence"))
    by = Window.partitionBy("company_id").orderBy("likelihood", F.desc("w"), "document_id", F.col("claim_id").cast("string"))
    return rows.withColumn("w", w).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def company_counts(docs: DataFrame, verdicts: DataFrame, omissions: DataFrame) -> DataFrame:
    """Documents, claims, omissions and verdicts of each category of every company."""
    from .summary import verdict_distribution

    v = verdict_distribution(verdicts, ["document_id"]).join(verdicts.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_claims")), "document_id")
    o = omissions.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_omissions"))
    joined = docs.join(v, "document_id", "left").join(o, "document_id", "left")
    from ..config import CATEGORIES

    return joined.groupBy("company_id").agg(F.count(F.lit(1)).alias("n_documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*CATEGORIES, "n_claims", "n_omissions")))


def collapse_best(records: DataFrame, key: Column, quality: list[Column]) -> DataFrame:
    """The best record of each key, with the number of the others added to ``duplicates``."""
    rows = records.withColumn("__k", key)
    best = Window.partitionBy("__k").orderBy(*quality)
    every = Window.partitionBy("__k")
    ranked = rows.withColumn("__r", F.row_number().over(best)).withColumn("duplicates", F.sum(F.coalesce("duplicates", F.lit(0)) + 1).over(every) - 1)
    return ranked.where("__r = 1").drop("__k", "__r")


def resolve_company(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, name): the exact name's slug, else the only one the query is a prefix of.  Slugs in ``slug``."""
    exact = queries.join(names, "slug").select("query", F.col("name").alias("exact"))
    q, n = queries.alias("q"), names.alias("n")
    # prefixes of names are exploded, so this stays an equality join
    prefixes = n.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.length("slug")), lambda i: F.substring("slug", 1, i))).alias("slug"))
    near = q.join(prefixes.groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("near")).where("n = 1"), "slug").select("query", "near")
    return queries.select("query").join(exact, "query", "left").join(near, "query", "left").select("query", F.coalesce("exact", "near").alias("name"))
