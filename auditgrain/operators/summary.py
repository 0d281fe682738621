"""From claims to a document's header: severity-leaning means, drivers, issues and credit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CATEGORIES, DEFAULT, DIMENSIONS, AuditConfig
from .verdict import clamp01, rounded


def weight(prominence: Column, confidence: Column, default: float = DEFAULT.default_prominence) -> Column:
    return F.greatest(F.coalesce(prominence, F.lit(default)) * confidence, F.lit(1e-6))


def _parts(power: float) -> tuple[Column, Column, Column, Column]:
    w = weight(F.col("prominence"), F.col("confidence"))
    share = F.when(F.col("score") > 0, w * F.pow("score", F.lit(power - 1)))
    return w, share, F.col("score") * share, F.col("confidence") * share


def lehmer(rows: DataFrame, keys: list[str], power: float = DEFAULT.power, round_stage: bool = True, n_drivers: int = 0, counts: dict[str, Column] | None = None) -> DataFrame:
    """Weighted Lehmer mean of ``score`` and the same mean of ``confidence`` for each group of ``keys``.

    Plain sums, so it is combined before the shuffle.  A group whose scores are all zero has score 0
    and the weighted mean confidence.  With ``n_drivers`` also ``drivers``, the targets of the largest contributors
    (groups of a document's rows), and with ``counts`` the number of rows where each condition holds, from the same aggregation."""
    w, share, s, c = _parts(power)
    total = F.sum(share)
    score = F.coalesce(F.try_divide(F.sum(s), total), F.lit(0.0))
    conf = F.coalesce(F.try_divide(F.sum(c), total), F.sum(F.col("confidence") * w) / F.sum(w))
    edge = clamp01 if round_stage else (lambda x: x)
    out = [edge(score).alias("score"), edge(conf).alias("confidence"), F.count(F.lit(1)).alias("n_rows")]
    if n_drivers:
        live = F.collect_list(F.when(share.isNotNull(), F.struct((-share).alias("raw"), F.col("target").alias("target"))))
        out.append(F.transform(F.slice(F.array_sort(live), 1, n_drivers), lambda x: x["target"]).alias("drivers"))
    out += [F.count_if(c).alias(n) for n, c in (counts or {}).items()]
    return rows.groupBy(keys).agg(*out)


def contributions(rows: DataFrame, keys: list[str], power: float = DEFAULT.power) -> DataFrame:
    """rows with a positive score, each with its ``share`` of the group's mean and its ``rank``, largest first."""
    _, share, _, _ = _parts(power)
    live = rows.where("score > 0").withColumn("raw", share)
    by = Window.partitionBy(keys)
    ranked = live.withColumn("rank", F.row_number().over(by.orderBy(F.desc("raw"), "target")))  # first, so that one sort serves both windows
    return ranked.withColumn("share", F.col("raw") / F.sum("raw").over(by)).drop("raw")


def drivers(rows: DataFrame, keys: list[str], n: int = DEFAULT.drivers, power: float = DEFAULT.power) -> DataFrame:
    """Targets of the ``n`` largest contributors of each group, largest first."""
    top = contributions(rows, keys, power).where(F.col("rank") <= n)
    return top.groupBy(keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]).alias("drivers"))


def profile_rows(claims: DataFrame, scores: DataFrame, verdicts: DataFrame, omissions: DataFrame) -> DataFrame:
    """(document_id, profile, target, score, confidence, prominence): what every header number is made of."""
    cols = ["document_id", "profile", "target", "score", "confidence", "prominence"]
    prominent = claims.select("document_id", "claim_id", "prominence")
    dims = scores.join(prominent, ["document_id", "claim_id"]).select("document_id", F.col("dimension").alias("profile"), F.col("claim_id").cast("string").alias("target"), "score", "confidence", "prominence")
    return dims.unionByName(issue_rows(verdicts, omissions).select(cols))


def claim_rows(verdicts: DataFrame) -> DataFrame:
    """The part of profile_rows that comes from verdicts which carry their dimension scores: one pass, no join."""
    dims = [F.struct(F.lit(d).alias("profile"), F.col(d).alias("score"), F.col(d + "_conf").alias("confidence")) for d in DIMENSIONS]
    head = F.struct(F.lit("headline").alias("profile"), F.col("likelihood").alias("score"), F.col("confidence").alias("confidence"))
    return verdicts.select("document_id", F.col("claim_id").cast("string").alias("target"), "prominence", F.inline(F.array(head, *dims))).where("score is not null")


def nested_contributions(verdicts: DataFrame, omissions: DataFrame, power: float = DEFAULT.power) -> DataFrame:
    """Contributions to every header number, from verdicts that carry their dimension scores; like header_of, each part is ranked where it stands."""
    parts = [contributions(rows, ["document_id", "profile"], power) for rows in (claim_rows(verdicts), omission_rows(omissions))]
    return parts[0].unionByName(parts[1])


def omission_rows(omissions: DataFrame) -> DataFrame:
    return omissions.select("document_id", F.col("omission_id").alias("target"), F.lit(1.0).alias("prominence"), F.lit("completeness").alias("profile"), "score", "confidence")


def header_of(verdicts: DataFrame, omissions: DataFrame, config: AuditConfig = DEFAULT, with_drivers: bool = False) -> DataFrame:
    """document_header from verdicts that carry their dimension scores.

    Claims and omissions make different profiles, so each part is rolled up where it stands and
    the two are put together afterwards: verdicts that are dealt out by document need no further shuffle."""
    keys = ["document_id", "profile"]
    parts = [lehmer(rows, keys, config.power, config.round_stages, config.drivers if with_drivers else 0) for rows in (claim_rows(verdicts), omission_rows(omissions))]
    return parts[0].unionByName(parts[1])


def issue_rows(verdicts: DataFrame, omissions: DataFrame) -> DataFrame:
    """Verdicts and omissions as one list of rows."""
    heads = verdicts.select("document_id", F.lit("headline").alias("profile"), F.col("claim_id").cast("string").alias("target"), F.col("likelihood").alias("score"), "confidence", "prominence")
    gaps = omissions.select("document_id", F.lit("completeness").alias("profile"), F.col("omission_id").alias("target"), "score", "confidence", F.lit(1.0).alias("prominence"))
    return heads.unionByName(gaps)


def document_header(claims: DataFrame, scores: DataFrame, verdicts: DataFrame, omissions: DataFrame, config: AuditConfig = DEFAULT) -> DataFrame:
    """(document_id, profile, score, confidence, drivers) for the headline, four dimensions and completeness."""
    rows = profile_rows(claims, scores, verdicts, omissions)
    keys = ["document_id", "profile"]
    return lehmer(rows, keys, config.power, config.round_stages).join(drivers(rows, keys, config.drivers, config.power), keys, "left")


def verdict_distribution(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Verdicts in each of the four categories, zeros included."""
    return verdicts.groupBy(keys).agg(*(F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES))


def top_issues(rows: DataFrame, k: int = DEFAULT.top_issues, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """The ``k`` most severe rows of each document: severity, score, then target."""
    ranked = rows.withColumn("severity", F.col("score") * weight(F.col("prominence"), F.col("confidence")))
    by = Window.partitionBy(*keys).orderBy(F.desc("severity"), F.desc("score"), *(c for c in ("document_id", "target") if c not in keys))
    return ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def credit(verdicts: DataFrame, k: int = DEFAULT.credit, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """The ``k`` best supported claims of each document: least score, then most prominent and sure."""
    rows = verdicts.where("category = 'supported'").withColumn("target", F.col("claim_id").cast("string"))
    by = Window.partitionBy(*keys).orderBy("likelihood", F.desc(F.col("prominence") * F.col("confidence")), *(c for c in ("document_id", "target") if c not in keys))
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def completeness(topics: DataFrame, omissions: DataFrame) -> DataFrame:
    """Worst omission of each document and their mean confidence; .15 with .6 or .4 where none is missing.

    topics: document_id, topic, covered (boolean)."""
    seen = topics.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_topics"), F.count_if("covered").alias("n_covered"))
    worst = omissions.groupBy("document_id").agg(F.max("score").alias("worst"), rounded(F.avg("confidence"), 2).alias("mean_conf"), F.count(F.lit(1)).alias("n_omissions"))
    none = F.when(F.col("n_covered") >= F.greatest(F.lit(1), F.col("n_topics") - 1), 0.6).otherwise(0.4)
    return seen.join(worst, "document_id", "left").select(
        "document_id", F.coalesce("worst", F.lit(0.15)).alias("score"), F.coalesce("mean_conf", none).alias("confidence"),
        F.coalesce("n_omissions", F.lit(0)).alias("n_omissions"),
    )


def fallback_title(text: Column, topic: Column) -> Column:
    """A target's own words, cut at 117 characters; an omission's topic."""
    return F.when(topic.isNotNull(), F.concat(F.lit("Not mentioned: "), topic)).when(F.length(text) > 120, F.concat(F.substring(text, 1, 117), F.lit("..."))).otherwise(text)


def drop_low_cards(omissions: DataFrame, min_score: float = DEFAULT.omission_bar) -> DataFrame:
    """Omissions scored below ``min_score`` count as addressed."""
    return omissions.where(F.col("score") >= min_score)
