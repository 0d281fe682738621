"""From dimension scores and evidence links to a verdict for every claim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DECISIVE, DIMENSIONS, PLACEHOLDER, TAGS, TIER_CAP

KEY = ["document_id", "claim_id"]


def rounded(c: Column, digits: int) -> Column:
    """Rounded half up; a hair is added first, so that a tie is one whatever the sums' order was."""
    return F.round(c + 1e-9, digits)


def clamp01(c: Column) -> Column:
    """Into [0, 1], two decimals."""
    return rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 2)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def scores_wide(claims: DataFrame, scores: DataFrame) -> DataFrame:
    """Claims with one score and one confidence column for each dimension; missing ones are null."""
    picks = [F.max(F.when(F.col("dimension") == d, F.col(c))).alias(d + e) for d in DIMENSIONS for c, e in (("score", ""), ("confidence", "_conf"))]
    return claims.join(scores.groupBy(KEY).agg(*picks), KEY, "left")


def likelihood() -> Column:
    """Weakest link: the highest score present; 0.5 if none."""
    return F.coalesce(F.greatest(*DIMENSIONS), F.lit(0.5))


def category(has_contradiction: Column) -> Column:
    sure = lambda d: (_zero(d) >= 0.7) & (_zero(d + "_conf") >= 0.6)
    top = F.greatest(*(_zero(d) for d in DIMENSIONS))
    return (
        F.when(has_contradiction & (sure("support") | sure("consistency")), "contradicted")
        .when((_zero("clarity") >= 0.7) | (_zero("support").between(0.4, 0.6) & (_zero("support_conf") < 0.6)), "unsubstantiated")
        .when(top > 0.5, "misleading_by_framing").otherwise("supported")
    )


def deciding_dimension() -> Column:
    """Dimension of the highest score; ties go to the least confidence, then to the fixed order."""
    rows = [F.when(F.col(d).isNotNull(), F.struct(F.col(d).alias("s"), (-F.col(d + "_conf")).alias("c"), F.lit(-i).alias("o"), F.lit(d).alias("d"))) for i, d in enumerate(DIMENSIONS)]
    return F.array_max(F.array_compact(F.array(*rows)))["d"]


def link_facts(links: DataFrame) -> DataFrame:
    """One row for each linked claim: its relations, best tier and number of items."""
    item = links.groupBy(*KEY, "evidence_id").agg(F.min("tier").alias("tier"), F.max(F.col("relation").isin(*DECISIVE)).alias("decisive"), F.collect_set("relation").alias("rel"))
    return item.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_items"), F.coalesce(F.min(F.when(F.col("decisive"), F.col("tier"))), F.min("tier")).alias("best_tier"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("rel")))).alias("relations"),
    )


def best_tier(links: DataFrame) -> DataFrame:
    """Lowest tier among evidence with a decisive relation, else among the rest."""
    return link_facts(links).select(*KEY, "best_tier")


def _has(relation: str) -> Column:
    return F.coalesce(F.array_contains("relations", relation), F.lit(False))


def verdict_confidence(agreement: Column | float = 1.0, stability: Column | float = 1.0, deciding: Column | None = None) -> Column:
    """Needs scores_wide joined to link_facts; ``deciding`` where the deciding dimension is a column already."""
    agreement, stability = (x if isinstance(x, Column) else F.lit(x) for x in (agreement, stability))
    deciding = deciding_dimension() if deciding is None else deciding
    base = reduce(lambda a, d: a.when(deciding == d, F.col(d + "_conf")), DIMENSIONS[1:], F.when(deciding == DIMENSIONS[0], F.col(DIMENSIONS[0] + "_conf")))
    tier = F.create_map(*[F.lit(x) for kv in TIER_CAP.items() for x in kv])[F.col("best_tier")]
    cap = F.when(F.col("n_items").isNull(), 0.55).when(deciding != "clarity", tier).otherwise(1.0)
    full = reduce(lambda a, d: a & F.col(d).isNotNull(), DIMENSIONS, F.lit(True))
    cap = F.least(cap, F.when(full, 1.0).otherwise(0.5))
    inside = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    value = F.least(base, cap) - 0.05 - F.when(_has("supports") & _has("contradicts"), 0.1).otherwise(0.0) - 0.1 * (1 - inside(agreement)) - 0.1 * (1 - inside(stability))
    confs = [_zero(d + "_conf") for d in DIMENSIONS]
    bounded = F.least(F.greatest(value, F.least(*confs) - 0.1), F.greatest(*confs))
    return clamp01(F.when(deciding.isNull(), 0.1).otherwise(bounded))


def confidence_reasons(deciding: Column | None = None) -> Column:
    """Which terms of verdict_confidence applied."""
    deciding = deciding_dimension() if deciding is None else deciding
    full = reduce(lambda a, d: a & F.col(d).isNotNull(), DIMENSIONS, F.lit(True))
    return F.array_compact(F.array(
        F.when(deciding.isNull(), "nothing_scored"), F.when(F.col("n_items").isNull(), "no_evidence"),
        F.when(F.col("n_items").isNotNull() & (deciding != "clarity") & (F.col("best_tier") > 1), "tier_cap"),
        F.when(~full, "dimension_missing"), F.when(_has("supports") & _has("contradicts"), "conflict"),
    ))


def propose_tags(signal_kinds: Column | None = None, changed: Column | None = None) -> Column:
    """Pattern tags by rule, in the taxonomy's order.  signal_kinds: kinds of marks that aren't credit;
    changed: whether an evidence item says that a target was changed."""
    kinds = F.coalesce(signal_kinds, F.array().cast("array<string>")) if signal_kinds is not None else F.array().cast("array<string>")
    changed = F.coalesce(changed, F.lit(False)) if changed is not None else F.lit(False)
    c, s, m, k = (_zero(d) for d in DIMENSIONS)
    kind = F.coalesce(F.col("type"), F.lit(""))
    framing = _has("contradicts_framing")
    rules = (
        c >= 0.6, F.col("n_items").isNull() | ((s >= 0.6) & ~_has("supports")),
        (m >= 0.6) | framing | F.arrays_overlap(kinds, F.array(F.lit("share_of_attention"), F.lit("buried_admission"))),
        (m >= 0.7) & (s <= 0.3), ((kind == "comparative") & (m >= 0.6)) | ((m >= 0.75) & framing),
        kind.isin("factual", "comparative") & _has("contradicts") & (s >= 0.7), (kind == "certification") & (s >= 0.5), changed | (k >= 0.6),
    )
    return F.array_compact(F.array(*(F.when(r, t) for r, t in zip(rules, TAGS, strict=True))))


def suppress_tags(category_col: Column, tags: Column) -> Column:
    """Supported verdicts carry no tags; others keep the taxonomy's order."""
    return F.when(category_col == "supported", F.array().cast("array<string>")).otherwise(F.array_intersect(F.array(*map(F.lit, TAGS)), tags))


def judge_consistency(judgments: DataFrame, derived: DataFrame) -> DataFrame:
    """(agreement with the derived category, share of the most frequent category) for each judged claim."""
    per = judgments.join(derived.select(*KEY, "category"), KEY).groupBy(*KEY, "category", "own_category").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(KEY).agg(
        rounded(F.sum(F.when(F.col("own_category") == F.col("category"), F.col("n")).otherwise(0)) / F.sum("n"), 2).alias("agreement"),
        rounded(F.max("n") / F.sum("n"), 2).alias("stability"),
    )


def nested_consistency(verdicts: DataFrame) -> DataFrame:
    """judge_consistency of verdicts that carry their judgments (``own_categories``, an array): no join, no grouping."""
    own, n = F.col("own_categories"), F.size("own_categories")
    most = F.array_max(F.transform(F.array_distinct(own), lambda x: F.size(F.filter(own, lambda y: y.eqNullSafe(x)))))
    agree = F.size(F.filter(own, lambda x: x == F.col("category")))
    return verdicts.where(n > 0).select(*KEY, rounded(agree / n, 2).alias("agreement"), rounded(most / n, 2).alias("stability"))


def nested_wide(claims: DataFrame) -> DataFrame:
    """Claims that carry their rows, ``scores`` array<struct<dimension, score, confidence>> and ``links``
    array<struct<evidence_id, tier, relation>>, with the columns of scores_wide and link_facts: no join, no shuffle."""
    one = lambda d: F.get(F.filter("scores", lambda x: x["dimension"] == d), F.lit(0))
    out = claims
    for d in DIMENSIONS:
        out = out.withColumns({d: one(d)["score"], d + "_conf": one(d)["confidence"]})
    some = F.size("links") > 0
    decisive = F.array_distinct(F.transform(F.filter("links", lambda x: x["relation"].isin(*DECISIVE)), lambda x: x["evidence_id"]))
    tiers = lambda rows: F.array_min(F.transform(rows, lambda x: x["tier"]))
    best = F.coalesce(tiers(F.filter("links", lambda x: F.array_contains("__decisive", x["evidence_id"]))), tiers("links"))
    return out.withColumn("__decisive", decisive).withColumns({
        "n_items": F.when(some, F.size(F.array_distinct(F.transform("links", lambda x: x["evidence_id"]))).cast("long")), "best_tier": F.when(some, best),
        "relations": F.when(some, F.array_sort(F.array_distinct(F.transform("links", lambda x: x["relation"])))),
    }).drop("scores", "links", "__decisive")


def derive_verdicts(claims: DataFrame, scores: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """One verdict for each claim: likelihood, category, confidence, deciding dimension, tags.

    Without ``scores`` and ``links`` the claims carry theirs, as for nested_wide."""
    wide = nested_wide(claims) if scores is None else scores_wide(claims, scores).join(link_facts(links), KEY, "left")
    out = wide.withColumns({"likelihood": likelihood(), "category": category(_has("contradicts")), "deciding": deciding_dimension()})
    out = out.withColumns({"confidence": verdict_confidence(deciding=F.col("deciding")), "reasons": confidence_reasons(F.col("deciding")), "proposed": propose_tags()})
    return out.withColumn("tags", suppress_tags(F.col("category"), F.col("proposed")))


def evidence_for(claims: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence items linked to known claims, each item once for a claim, with its relations."""
    return links.join(claims.select(KEY), KEY).groupBy(*KEY, "evidence_id").agg(F.min("tier").alias("tier"), F.array_sort(F.collect_set("relation")).alias("relations"))


def fully_scored(claims: DataFrame, scores: DataFrame) -> DataFrame:
    """claims with ``ready``: whether all four dimensions are scored."""
    have = scores.where(F.col("dimension").isin(*DIMENSIONS)).groupBy(KEY).agg(F.collect_set("dimension").alias("dims"))
    need = F.array(*map(F.lit, DIMENSIONS))
    return claims.join(have, KEY, "left").withColumn("ready", F.col("dims").isNotNull() & (F.size(F.array_except(need, F.coalesce("dims", F.array().cast("array<string>")))) == 0)).drop("dims")


def fill_placeholders(claims: DataFrame, scores: DataFrame) -> DataFrame:
    """scores with a neutral row for every claim and dimension that has none."""
    dims = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.lit(s).alias("score"), F.lit(c).alias("confidence")) for d, (s, c) in PLACEHOLDER.items())))
    want = claims.select(*KEY, dims.alias("x")).select(*KEY, "x.*")
    missing = want.join(scores.select(*KEY, "dimension"), [*KEY, "dimension"], "left_anti")
    cols = [*KEY, "dimension", "score", "confidence"]
    return scores.select(*cols, F.lit(False).alias("placeholder")).unionByName(missing.select(*cols, F.lit(True).alias("placeholder")))


def valid_citations(cites: DataFrame, links: DataFrame) -> DataFrame:
    """``cites`` (document_id, claim_id, evidence_ids array) with the ids that are linked to the claim, in
    order and once, and the number of unknown ones."""
    flat = cites.select(*KEY, F.posexplode_outer(F.array_distinct("evidence_ids")).alias("pos", "evidence_id"))
    known = links.select(*KEY, "evidence_id").distinct().withColumn("ok", F.lit(True))
    return flat.join(known, [*KEY, "evidence_id"], "left").groupBy(KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("pos", "evidence_id")))), lambda x: x["evidence_id"]).alias("evidence_ids"),
        F.count_if(F.col("evidence_id").isNotNull() & F.col("ok").isNull()).alias("n_unknown"),
    )


def visible_quotes(verified: Column, method: Column, quote: Column) -> Column:
    """The quote, where it was verified; null otherwise."""
    return F.when(F.coalesce(verified, F.lit(False)) & (F.coalesce(method, F.lit("unverified")) != "unverified"), quote)


def derive_tier(independence: Column) -> Column:
    # fixed values of the contract
    table = {"regulator": 1, "assured_filing": 2, "government": 2, "independent": 3, "news": 4, "company": 5}
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[independence]


def downgrade_self_support(links: DataFrame) -> DataFrame:
    """Tier 5 cannot support: such links become context, marked ``downgraded``."""
    own = (F.col("tier") == 5) & (F.col("relation") == "supports")
    return links.withColumn("downgraded", F.coalesce(own, F.lit(False))).withColumn("relation", F.when(F.col("downgraded"), "context").otherwise(F.col("relation")))


def derive_change(kind: Column) -> Column:
    """(relation, target_changed) of a change between versions."""
    # fixed values of the contract: these contradict the framing, other kinds are context
    against = ("weakened", "dropped", "delayed", "scope_narrowed", "restated", "softened")
    return F.struct(
        F.when(kind.isin(*against), "contradicts_framing").otherwise("context").alias("relation"),
        F.coalesce(kind.isin("weakened", "dropped", "delayed"), F.lit(False)).alias("target_changed"),
    )


def computation_tier(items: DataFrame, derived: DataFrame) -> DataFrame:
    """Tier of computed items: the worst of their inputs, 5 when none is known.

    items: document_id, evidence_id, tier; derived: document_id, evidence_id, derived_from (array)."""
    flat = derived.select("document_id", "evidence_id", F.explode_outer("derived_from").alias("input"))
    inputs = items.select("document_id", F.col("evidence_id").alias("input"), F.col("tier").alias("input_tier"))
    return flat.join(inputs, ["document_id", "input"], "left").groupBy("document_id", "evidence_id").agg(
        F.coalesce(F.max("input_tier"), F.lit(5)).alias("tier"), F.count_if(F.col("input").isNotNull() & F.col("input_tier").isNull()).alias("n_unknown"),
    )
