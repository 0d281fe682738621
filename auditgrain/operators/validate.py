"""Contract checks as a job: every rule gives (rule, severity, document_id, entity_id, detail) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CATEGORIES, DIMENSION_STAGES, DIMENSIONS, EVALUATOR_STAGES, EVENT_STAGES, ROUNDING, STAGES, STEADY_MAX
from ..functions import text as tx
from .verdict import category, likelihood, link_facts, nested_wide, scores_wide


def _row(df: DataFrame, rule: str, entity: Column, detail: Column, severity: str = "error", document: Column | None = None) -> DataFrame:
    d = document if document is not None else F.col("document_id")
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), d.cast("string").alias("document_id"), entity.cast("string").alias("entity_id"), detail.alias("detail"))


def check_q01(docs: DataFrame) -> DataFrame:
    """Canonical text; the recorded word count agrees (warning)."""
    bad = docs.select("document_id", F.explode(tx.canonical_violations(F.col("text"))).alias("v"))
    out = _row(bad, "Q1", F.col("document_id"), F.col("v"))
    if "word_count" in docs.columns:
        out = out.unionByName(_row(docs.where(F.col("word_count") != tx.word_count(F.col("text"))), "Q1", F.col("document_id"), F.lit("word_count"), "warning"))
    return out


def check_q02(ids: DataFrame) -> DataFrame:
    """Ids (document_id, id) of all entities occur once."""
    return _row(ids.groupBy("document_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "Q2", F.col("id"), F.concat(F.lit("repeated "), F.col("n").cast("string")))


def check_q03(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans lie in the text and equal its slice."""
    j = spans.join(docs.select("document_id", F.col("text").alias("__t")), "document_id")
    n = F.col("end") - F.col("start")
    out = (F.col("start") < 0) | (n <= 0) | (F.col("end") > F.length("__t"))
    wrong = F.substring("__t", F.col("start").cast("int") + 1, n.cast("int")) != F.col("text")
    return _row(j.where(out | wrong), "Q3", F.col("owner_id"), F.when(out, "out of range").otherwise("not the text"))


def check_q05(regions: DataFrame, docs: DataFrame) -> DataFrame:
    """Regions lie in the text, labels are unique, regions of one kind do not overlap."""
    j = regions.join(docs.select("document_id", F.length("text").alias("__n")), "document_id")
    far = _row(j.where("start < 0 or end <= start or end > __n"), "Q5", F.col("start"), F.lit("out of range"))
    twice = _row(regions.where("label is not null").groupBy("document_id", "label").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "Q5", F.col("label"), F.lit("label repeated"))
    before = F.lag("end").over(Window.partitionBy("document_id", "kind").orderBy("start", "end"))
    over = _row(regions.withColumn("__b", before).where("__b > start"), "Q5", F.col("start"), F.lit("overlap"))
    return far.unionByName(twice).unionByName(over)


def check_q07(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets of evidence exist, no link is repeated, tier 5 does not support (warning)."""
    lost = _row(links.join(targets.select("document_id", "claim_id"), ["document_id", "claim_id"], "left_anti"), "Q7", F.col("evidence_id"), F.lit("unknown target"))
    twice = _row(links.groupBy("document_id", "claim_id", "evidence_id", "relation").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "Q7", F.col("evidence_id"), F.lit("repeated link"))
    return lost.unionByName(twice).unionByName(_row(links.where("tier = 5 and relation = 'supports'"), "Q7", F.col("evidence_id"), F.lit("tier 5 supports"), "warning"))


def check_q04(signals: DataFrame, claims: DataFrame) -> DataFrame:
    """Signals of a claim's level have spans, and name claims that exist.  signals: document_id, signal_id, level, n_spans, claim_ids (array)."""
    bare = _row(signals.where("level = 'claim' and n_spans = 0"), "Q4", F.col("signal_id"), F.lit("no span"))
    named = signals.select("document_id", "signal_id", F.explode("claim_ids").alias("claim_id"))
    lost = named.join(claims.select("document_id", "claim_id"), ["document_id", "claim_id"], "left_anti")
    return bare.unionByName(_row(lost, "Q4", F.col("signal_id"), F.concat(F.lit("unknown claim "), F.col("claim_id").cast("string"))))


def check_q06(claims: DataFrame, regions: DataFrame) -> DataFrame:
    """A claim's paragraph is a labelled paragraph of its document and holds its first span.  claims: document_id, claim_id, paragraph, start, end."""
    p = regions.where("kind = 'paragraph' and label is not null").groupBy("document_id", F.col("label").alias("paragraph")).agg(F.max(F.struct(F.col("start").alias("r_start"), F.col("end").alias("r_end"))).alias("r"))
    j = claims.where("paragraph is not null").join(p, ["document_id", "paragraph"], "left")
    lost, out = F.col("r").isNull(), (F.col("start") < F.col("r.r_start")) | (F.col("end") > F.col("r.r_end"))
    return _row(j.where(lost | out), "Q6", F.col("claim_id"), F.when(lost, "unknown paragraph").otherwise("outside its paragraph"))


def check_q08(evidence: DataFrame) -> DataFrame:
    """What evidence is derived from exists and isn't itself; verified evidence has a quote; a computation's tier is no
    better than that of its worst input (warning).  evidence: document_id, evidence_id, kind, tier, verified, quote, derived_from (array)."""
    used = evidence.select("document_id", "evidence_id", "kind", F.col("tier").alias("own"), F.explode("derived_from").alias("d"))
    tiers = evidence.groupBy("document_id", F.col("evidence_id").alias("d")).agg(F.max("tier").alias("tier"))
    j = used.join(tiers, ["document_id", "d"], "left")
    lost = _row(j.where("tier is null"), "Q8", F.col("evidence_id"), F.concat(F.lit("derived from unknown "), F.col("d").cast("string")))
    own = _row(used.where("d = evidence_id"), "Q8", F.col("evidence_id"), F.lit("derived from itself"))
    bare = _row(evidence.where("verified and coalesce(quote, '') = ''"), "Q8", F.col("evidence_id"), F.lit("verified without a quote"))
    worst = j.groupBy("document_id", "evidence_id").agg(F.max(F.coalesce("tier", F.lit(5))).alias("worst"))
    c = evidence.where("kind = 'computation'").join(worst, ["document_id", "evidence_id"], "left").where(F.col("tier") < F.coalesce("worst", F.lit(5)))
    return lost.unionByName(own).unionByName(bare).unionByName(_row(c, "Q8", F.col("evidence_id"), F.lit("better than its inputs"), "warning"))


def check_q09(evidence: DataFrame, scores: DataFrame) -> DataFrame:
    """The stage that made evidence or a score may make it.  evidence: document_id, evidence_id, stage; scores: document_id, claim_id, dimension, stage."""
    e = evidence.where(F.col("stage").isNotNull() & ~F.col("stage").isin(*EVALUATOR_STAGES, "omissions"))
    may = F.lit(False)
    for d, stages in DIMENSION_STAGES.items():
        may = may | ((F.col("dimension") == d) & F.col("stage").isin(*stages))
    s = scores.where(F.col("stage").isNotNull() & ~may)
    return _row(e, "Q9", F.col("evidence_id"), F.concat(F.lit("stage "), "stage")).unionByName(_row(s, "Q9", F.col("claim_id"), F.concat_ws(" ", F.lit("stage"), "stage", "dimension")))


def _unknown(cites: DataFrame, evidence: DataFrame, rule: str, entity: str) -> DataFrame:
    """cites (document_id, entity, evidence_ids) of evidence that does not exist; ``n``, if given, is how often a row stands there."""
    named = cites.select("document_id", entity, F.explode("evidence_ids").alias("evidence_id"), *(["n"] if "n" in cites.columns else []))
    lost = named.join(evidence.select("document_id", "evidence_id").distinct(), ["document_id", "evidence_id"], "left_anti")
    if "n" in cites.columns:
        lost = lost.select("document_id", entity, "evidence_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return _row(lost, rule, F.col(entity), F.concat(F.lit("unknown evidence "), F.col("evidence_id").cast("string")))


def check_q10(claims: DataFrame, scores: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One score for each claim and dimension, none missing, on known claims; with ``evidence``, citing known evidence (evidence_ids)."""
    key = ["document_id", "claim_id"]
    # one row for the known dimensions of a claim and the claim itself, one for each other dimension: no joins
    known = F.coalesce(F.col("dimension").isin(*DIMENSIONS), F.lit(False))
    rows = scores.select(*key, known.alias("known"), "dimension", F.lit(0).alias("claim")).unionByName(claims.select(*key, F.lit(True).alias("known"), F.lit(None).cast("string").alias("dimension"), F.lit(1).alias("claim")))
    other = F.when(~F.col("known"), F.col("dimension")).alias("other")
    counts = [F.count_if(F.col("dimension") == d).alias(d) for d in DIMENSIONS]
    n = rows.groupBy(*key, "known", other).agg(F.sum("claim").alias("claims"), F.count_if(F.col("claim") == 0).alias("n"), *counts)
    there = F.coalesce(F.sum("claims").over(Window.partitionBy(key)), F.lit(0)) * F.when(F.col("document_id").isNull() | F.col("claim_id").isNull(), 0).otherwise(1)
    n = n.withColumn("there", there)
    times = lambda detail, k: F.array_repeat(detail, k.cast("int"))
    said = [times(F.lit("unknown claim"), F.when(F.col("there") == 0, F.col("n")).otherwise(0)), times(F.concat(F.lit("repeated "), "other"), F.when(~F.col("known") & (F.col("n") > 1), 1).otherwise(0))]
    for d in DIMENSIONS:
        said.append(times(F.lit(f"repeated {d}"), F.when(F.col(d) > 1, 1).otherwise(0)))
        said.append(times(F.lit(f"no {d}"), F.when((F.col(d) == 0) | (F.col("there") == 0), F.col("claims")).otherwise(0)))
    whole = F.col("known") & (F.col("there") == 1) & (F.least(*DIMENSIONS) == 1) & (F.greatest(*DIMENSIONS) == 1)  # nothing to say
    out = _row(n.where(~whole).select(*key, F.explode(F.flatten(F.array(*said))).alias("detail")), "Q10", F.col("claim_id"), F.col("detail"))
    if evidence is None:
        return out
    cites = scores.groupBy(*key, "evidence_ids").agg(F.count(F.lit(1)).alias("n"))  # scores of a claim mostly cite the same
    return out.unionByName(_unknown(cites, evidence, "Q10", "claim_id"))


def check_q11(verdicts: DataFrame, claims: DataFrame, arguments: DataFrame | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """Verdicts are on known claims, one for each; arguments too; with ``evidence``, both cite known evidence (evidence_ids)."""
    key = ["document_id", "claim_id"]
    known = claims.select(key)
    lost = _row(verdicts.join(known, key, "left_anti"), "Q11", F.col("claim_id"), F.lit("unknown claim"))
    n = verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    out = lost.unionByName(_row(n.where("n > 1"), "Q11", F.col("claim_id"), F.lit("repeated verdict")))
    out = out.unionByName(_row(known.distinct().join(n, key, "left_anti"), "Q11", F.col("claim_id"), F.lit("no verdict")))
    if arguments is not None:
        out = out.unionByName(_row(arguments.join(known, key, "left_anti"), "Q11", F.col("claim_id"), F.lit("argument for an unknown claim")))
    if evidence is not None:
        for cites in (x for x in (verdicts, arguments) if x is not None):
            out = out.unionByName(_unknown(cites, evidence, "Q11", "claim_id"))
    return out


def check_q12(verdicts: DataFrame, claims: DataFrame | None = None, scores: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """Likelihood and category follow from the scores; confidence is within their range (warning).

    Without ``scores`` and ``links`` the claims carry theirs, as for nested_wide; without claims the verdicts
    carry the columns of nested_wide beside what is recorded, and the rule is worked out on the same row."""
    key = ["document_id", "claim_id"]
    w = verdicts if claims is None else nested_wide(claims) if scores is None else scores_wide(claims, scores).join(link_facts(links), key, "left")
    contra = F.coalesce(F.array_contains("relations", "contradicts"), F.lit(False))
    confs = [F.coalesce(F.col(d + "_conf"), F.lit(0.0)) for d in DIMENSIONS]
    own = [*key] if claims is not None else [*key, "likelihood", "category", "confidence"]
    rule = w.select(*own, likelihood().alias("__l"), category(contra).alias("__c"), (F.least(*confs) - 0.1).alias("__lo"), F.greatest(*confs).alias("__hi"))
    off = F.array_compact(F.array(
        F.when(F.abs(F.col("likelihood") - F.col("__l")) > 0.005, F.struct(F.lit("likelihood").alias("what"), F.lit("error").alias("severity"))),
        F.when(F.col("category") != F.col("__c"), F.struct(F.lit("category").alias("what"), F.lit("error").alias("severity"))),
        F.when((F.col("confidence") < F.col("__lo") - 0.005) | (F.col("confidence") > F.col("__hi") + 0.005), F.struct(F.lit("confidence").alias("what"), F.lit("warning").alias("severity"))),
    ))
    bad = (rule if claims is None else verdicts.join(rule, key)).select("document_id", "claim_id", F.inline(off))
    return bad.select(F.lit("Q12").alias("rule"), "severity", F.col("document_id").cast("string").alias("document_id"), F.col("claim_id").cast("string").alias("entity_id"), F.col("what").alias("detail"))


def check_q13(summaries: DataFrame, verdicts: DataFrame, claims: DataFrame | None = None, omissions: DataFrame | None = None, issues: DataFrame | None = None, credit: DataFrame | None = None) -> DataFrame:
    """Recorded numbers of a summary hold: the distribution of categories (a column for each) always; with claims and
    omissions their counts (claim_count, omission_count); with issues (document_id, rank, target) that ranks are 1..n and
    targets exist; with credit (document_id, target) that its targets are claims, and supported ones (warning)."""
    n = verdicts.groupBy("document_id").agg(*(F.count_if(F.col("category") == c).alias("__" + c) for c in CATEGORIES))
    j = summaries.join(n, "document_id", "left")
    wrong = F.array_compact(F.array(*(F.when(F.col(c) != F.coalesce("__" + c, F.lit(0)), c) for c in CATEGORIES)))
    out = _row(j.select("document_id", F.explode(wrong).alias("c")), "Q13", F.col("c"), F.lit("distribution"))
    for name, rows in (("claim_count", claims), ("omission_count", omissions)):
        if rows is not None:
            k = summaries.join(rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("__n")), "document_id", "left")
            out = out.unionByName(_row(k.where(F.col(name) != F.coalesce("__n", F.lit(0))), "Q13", F.lit(name), F.lit("count")))
    ids = None if claims is None else claims.select("document_id", F.col("claim_id").cast("string").alias("target"))
    if issues is not None:
        out = out.unionByName(_ranks(issues, "document_id", "Q13"))
        both = ids if omissions is None else ids.unionByName(omissions.select("document_id", F.col("omission_id").alias("target")))
        out = out.unionByName(_row(issues.join(both, ["document_id", "target"], "left_anti"), "Q13", F.col("target"), F.lit("unknown target")))
    if credit is not None:
        out = out.unionByName(_row(credit.join(ids, ["document_id", "target"], "left_anti"), "Q13", F.col("target"), F.lit("credit to no claim")))
        v = verdicts.select("document_id", F.col("claim_id").cast("string").alias("target"), "category")
        out = out.unionByName(_row(credit.join(v, ["document_id", "target"]).where("category <> 'supported'"), "Q13", F.col("target"), F.lit("credit not supported"), "warning"))
    return out


def _ranks(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """Ranks of each key are 1..n: as many different ones as rows, from 1 to their number."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return _row(g.where("n <> d or lo <> 1 or hi <> n"), rule, F.col(key), F.lit("ranks"), document=F.col(key))


def check_q14(companies: DataFrame, listed: DataFrame) -> DataFrame:
    """A company's view lists each document once, oldest first (undated ones before), and its counts are sums over them.

    companies: company_id, document_count, claim_count, omission_count and a column for each category; listed: company_id,
    place, document_id, doc_date, claim_count, omission_count and the categories."""
    cid, sums = F.col("company_id"), ["claim_count", "omission_count", *CATEGORIES]
    twice = listed.groupBy("company_id", "document_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = _row(twice, "Q14", F.col("document_id"), F.lit("listed again"), document=cid)
    g = listed.groupBy("company_id").agg(F.count(F.lit(1)).alias("__document_count"), *(F.sum(c).alias("__" + c) for c in sums))
    j = companies.join(g, "company_id", "left")
    wrong = F.array_compact(F.array(*(F.when(F.col(c) != F.coalesce("__" + c, F.lit(0)), c) for c in ["document_count", *sums])))
    out = out.unionByName(_row(j.select("company_id", F.explode(wrong).alias("c")), "Q14", F.col("c"), F.lit("sum"), document=cid))
    day = F.coalesce("doc_date", F.lit("0001-01-01").cast("date"))
    before = listed.withColumn("__p", F.lag(day).over(Window.partitionBy("company_id").orderBy("place")))
    return out.unionByName(_row(before.where(F.col("__p") > day), "Q14", F.col("document_id"), F.lit("out of order"), document=cid))


def check_q15(companies: DataFrame, documents: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """A company's numbers lie within those of its documents (company_id, score, and profile where there is one); a headline
    below their mean is a warning; with ``shares`` (company_id, score, share) the shares add up to 1 (0 when no score is above 0)."""
    key = ["company_id", "profile"] if "profile" in companies.columns else ["company_id"]
    entity = F.col(key[-1])
    r = documents.groupBy(key).agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("mean"))
    j = companies.join(r, key)
    out = _row(j.where(f"score < lo - {ROUNDING} or score > hi + {ROUNDING}"), "Q15", entity, F.lit("out of range"), document=F.col("company_id"))
    low = j.where(f"score < mean - {ROUNDING}" + (" and profile = 'headline'" if len(key) == 2 else ""))
    out = out.unionByName(_row(low, "Q15", entity, F.lit("below mean"), "warning", F.col("company_id")))
    if shares is not None:
        g = shares.groupBy("company_id").agg(F.sum("share").alias("s"), F.max((F.col("score") > 0).cast("int")).alias("want")).where("abs(s - want) > 0.02")
        out = out.unionByName(_row(g, "Q15", F.col("company_id"), F.lit("shares"), document=F.col("company_id")))
    return out


def check_q16(trends: DataFrame, documents: DataFrame) -> DataFrame:
    """A trend agrees with its documents: number of dated ones, both ends, change, span, the sign of its direction, and a
    confidence no higher than that of its ends.

    trends: company_id, points, direction, change, span_days, per_year, confidence, first_id, first_score, last_id,
    last_score; documents: company_id, document_id, doc_date, score, confidence."""
    dated = documents.where("doc_date is not null")
    at = F.struct("doc_date", "document_id")
    end = F.struct("document_id", "doc_date", "score", "confidence")
    g = dated.groupBy("company_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(end, at).alias("a"), F.max_by(end, at).alias("z"))
    j = trends.join(g, "company_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c, none = F.col("direction"), F.col("direction") == "undetermined"
    real = ~none & (F.col("n") >= 2)
    ends = F.col("first_id").isNull() | F.col("last_id").isNull()
    full = real & ~ends
    off = lambda x, y: F.abs(x - y) > ROUNDING
    rules = F.array_compact(F.array(
        F.when(F.col("points") != F.col("n"), "points"), F.when(none & (F.col("n") >= 2), "undetermined on two documents"),
        F.when(none & (F.col("change").isNotNull() | (F.col("confidence") != 0)), "undetermined with a change"), F.when(~none & (F.col("n") < 2), "direction on one document"),
        F.when(real & ends, "no ends"), F.when(full & ((F.col("first_id") != F.col("a.document_id")) | off(F.col("first_score"), F.col("a.score"))), "first"),
        F.when(full & ((F.col("last_id") != F.col("z.document_id")) | off(F.col("last_score"), F.col("z.score"))), "last"),
        F.when(full & off(F.col("change"), F.col("last_score") - F.col("first_score")), "change"), F.when(full & (F.col("span_days") != F.datediff("z.doc_date", "a.doc_date")), "span"),
        F.when(full & (((c == "worsening") & (F.col("change") <= 0)) | ((c == "improving") & (F.col("change") >= 0)) | ((c == "steady") & (F.abs("change") > STEADY_MAX))), "direction"),
        F.when(full & F.col("per_year").isNotNull() & (F.col("span_days") == 0), "pace without time"),
        F.when(full & (F.col("confidence") > F.least("a.confidence", "z.confidence") + ROUNDING), "confidence"),
    ))
    return _row(j.withColumn("r", F.explode(rules)), "Q16", F.col("company_id"), F.col("r"), document=F.col("company_id"))


def check_q17(events: DataFrame, prerequisites: dict | None = None) -> DataFrame:
    """Every stage starts and ends once, in that order; with ``prerequisites`` (stage: stages before it, as PREREQUISITES of the
    contract) those have ended when it starts.  events: analysis_id, seq, type, entity_id (the stage)."""
    g = events.where(F.col("type").isin("stage.started", "stage.completed")).groupBy("analysis_id", "entity_id").agg(
        F.count_if(F.col("type") == "stage.started").alias("s"), F.count_if(F.col("type") == "stage.completed").alias("c"),
        F.min(F.when(F.col("type") == "stage.started", F.col("seq"))).alias("a"), F.min(F.when(F.col("type") == "stage.completed", F.col("seq"))).alias("b"))
    rules = F.array_compact(F.array(F.when(F.col("s") == 0, "not started"), F.when(F.col("s") > 1, "started again"), F.when(F.col("c") == 0, "not closed"), F.when(F.col("c") > 1, "closed again"), F.when(F.col("b") < F.col("a"), "closed first")))
    out = _row(g.withColumn("r", F.explode(rules)), "Q17", F.col("entity_id"), F.col("r"), document=F.col("analysis_id"))
    if prerequisites is None:
        return out
    need = events.sparkSession.createDataFrame([(s, p) for s, ps in prerequisites.items() for p in ps], f"entity_id {events.schema['entity_id'].dataType.simpleString()}, before {events.schema['entity_id'].dataType.simpleString()}")
    done = g.select("analysis_id", F.col("entity_id").alias("before"), F.col("b").alias("done"))
    early = g.where("a is not null").select("analysis_id", "entity_id", "a").join(need, "entity_id").join(done, ["analysis_id", "before"], "left").where("done is null or done > a")
    return out.unionByName(_row(early, "Q17", F.col("entity_id"), F.concat(F.lit("before "), F.col("before").cast("string")), document=F.col("analysis_id")))


def check_q18(events: DataFrame, owners: DataFrame, uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """Domain events stand inside a stage that owns them, and nothing is used before it is defined (or never is).

    events: analysis_id, seq, type, entity_id; owners: type, stage; uses: analysis_id, seq, ref; definitions: analysis_id, seq, id."""
    from .eventlog import events_in_stage, stage_spans, use_before_definition

    out = events_in_stage(events, stage_spans(events), owners).where("not inside")
    early = use_before_definition(uses, definitions)
    first = _row(out, "Q18", F.col("seq"), F.concat("type", F.lit(" outside its stage")), document=F.col("analysis_id"))
    return first.unionByName(_row(early, "Q18", F.col("seq"), F.when(F.col("defined").isNull(), F.concat(F.lit("never defined "), F.col("ref").cast("string"))).otherwise(F.concat(F.lit("used before "), F.col("ref").cast("string"))), document=F.col("analysis_id")))


def event_owners(spark) -> DataFrame:
    """(type, stage): which stages own which events, by the contract."""
    return spark.createDataFrame([(t, s) for t, stages in EVENT_STAGES.items() for s in stages], "type string, stage string")


def check_q19(verdicts: DataFrame, scores: DataFrame, finals: DataFrame, completed: DataFrame, counted: DataFrame, n_dimensions: int = len(DIMENSIONS)) -> DataFrame:
    """A verdict comes after all dimensions of its claim were scored; a completed analysis has one final summary, and its counts are those of its events.

    verdicts: analysis_id, seq, claim_id; scores: analysis_id, seq, claim_id, dimension; finals: analysis_id, seq of final
    summaries; completed: analysis_id and named counts (a column each); counted: analysis_id and the same columns."""
    scored = scores.groupBy("analysis_id", "claim_id", "dimension").agg(F.min("seq").alias("at"))
    when = scored.groupBy("analysis_id", "claim_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("at"))
    # the last of the dimensions decides: with all of them scored, the latest first score
    early = verdicts.join(when, ["analysis_id", "claim_id"], "left").where(f"n is null or n < {n_dimensions} or at > seq")
    out = _row(early, "Q19", F.col("claim_id"), F.lit("verdict before its scores"), document=F.col("analysis_id"))
    k = completed.select("analysis_id").join(finals.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("k")), "analysis_id", "left").where("coalesce(k, 0) <> 1")
    out = out.unionByName(_row(k, "Q19", F.col("analysis_id"), F.concat(F.coalesce(F.col("k"), F.lit(0)).cast("string"), F.lit(" final summaries")), document=F.col("analysis_id")))
    names = [c for c in completed.columns if c != "analysis_id"]
    j = completed.join(counted.select("analysis_id", *(F.col(c).alias("__" + c) for c in names)), "analysis_id", "left")
    wrong = F.array_compact(F.array(*(F.when(F.col(c) != F.coalesce("__" + c, F.lit(0)), c) for c in names)))
    return out.unionByName(_row(j.select("analysis_id", F.explode(wrong).alias("c")), "Q19", F.col("c"), F.lit("count"), document=F.col("analysis_id")))


def check_stages_closed(events: DataFrame) -> DataFrame:
    """Of completed analyses, stages of the contract that never ended."""
    done = events.where("type = 'stage.completed'").select("analysis_id", F.col("entity_id").alias("stage")).distinct()
    want = events.where("type = 'analysis.completed'").select("analysis_id").distinct().select("analysis_id", F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    return _row(want.join(done, ["analysis_id", "stage"], "left_anti"), "Q17", F.col("stage"), F.lit("never completed"), document=F.col("analysis_id"))


def validate(checks: list[DataFrame]) -> DataFrame:
    """All violations as one table."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
