"""Queries of the contract checks on damaged tables; the SQL takes the same damaged rows and evaluates the rule itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import company as co
from ..operators import spans as sp
from ..operators import validate as va
from ..scratch import settled
from .queries_audit import _TREND, header, verdicts
from .queries_match import _REGIONS
from .registry import query

_KEY = ["document_id", "claim_id"]


def _v(rule: str, entity: str, detail: str, rows: str, severity: str = "error", document: str = "document_id") -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, CAST({document} AS VARCHAR) AS document_id, CAST({entity} AS VARCHAR) AS entity_id, CAST({detail} AS VARCHAR) AS detail FROM {rows}"


def _sql(ctes: str, *parts: str) -> str:
    return f"WITH {ctes} " + " UNION ALL ".join(parts)


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"
_BROKEN = r"""[CASE WHEN text = '' THEN 'empty' END, CASE WHEN contains(text, chr(13)) THEN 'carriage_return' END, CASE WHEN regexp_matches(text, '[\t\x0b\f\x{a0}]') THEN 'other_whitespace' END,
 CASE WHEN contains(text, '  ') THEN 'double_space' END, CASE WHEN contains(text, ' ' || chr(10)) OR contains(text, chr(10) || ' ') THEN 'space_at_line_edge' END, CASE WHEN contains(text, chr(10) || chr(10) || chr(10)) THEN 'blank_line_run' END,
 CASE WHEN text <> '' AND regexp_matches(text, '^\s|\s$') THEN 'outer_whitespace' END]"""


@query(_sql(
    f"d AS (SELECT doc_id AS document_id, text, {_WORDS} + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS word_count FROM documents)",
    _v("Q1", "document_id", "v", f"(SELECT document_id, unnest(list_filter({_BROKEN}, lambda x: x IS NOT NULL)) AS v FROM d)"), _v("Q1", "document_id", "'word_count'", f"d WHERE word_count <> {_WORDS}", "warning"),
))
def q01_canonical(t):
    from ..functions import text as tx

    n = tx.word_count(F.col("text")) + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0)
    return va.check_q01(t.documents.select(F.col("doc_id").alias("document_id"), "text", n.alias("word_count")))


def _lines(t):
    return sp.line_regions(t.documents)


@query(_sql(
    f"r AS ({_REGIONS}), s AS (SELECT document_id, line_no, start + CASE WHEN line_no % 5 = 2 THEN 1 ELSE 0 END AS a, start + len + CASE WHEN line_no % 7 = 3 THEN 100000 ELSE 0 END AS e, line FROM r), j AS (SELECT s.*, d.text, a < 0 OR e <= a OR e > length(d.text) AS far FROM s JOIN documents d ON d.doc_id = s.document_id)",
    _v("Q3", "line_no", "CASE WHEN far THEN 'out of range' ELSE 'not the text' END", "j WHERE far OR substr(text, a + 1, e - a) <> line"),
))
def q03_spans(t):
    n = F.col("line_no")
    s = _lines(t).select("document_id", n.alias("owner_id"), (F.col("start") + F.when(n % 5 == 2, 1).otherwise(0)).alias("start"), (F.col("end") + F.when(n % 7 == 3, 100_000).otherwise(0)).alias("end"), "text")
    return va.check_q03(s, t.documents.select(F.col("doc_id").alias("document_id"), "text"))


@query(_sql(
    "s AS (SELECT document_id, claim_id AS signal_id, CASE WHEN p % 4 = 0 THEN 'document' ELSE 'claim' END AS level, s % 3 AS n_spans, [claim_id, claim_id + 1] AS ids FROM v_base)",
    _v("Q4", "signal_id", "'no span'", "s WHERE level = 'claim' AND n_spans = 0"),
    _v("Q4", "signal_id", "'unknown claim ' || c", "(SELECT document_id, signal_id, unnest(ids) AS c FROM s) x WHERE NOT EXISTS (SELECT 1 FROM v_claims v WHERE v.document_id = x.document_id AND v.claim_id = x.c)"),
))
def q04_signals(t):
    s = t.v_base.select("document_id", F.col("claim_id").alias("signal_id"), F.when(F.col("p") % 4 == 0, "document").otherwise("claim").alias("level"), (F.col("s") % 3).alias("n_spans"), F.array("claim_id", F.col("claim_id") + 1).alias("claim_ids"))
    return va.check_q04(s, t.v_claims)


@query(_sql(
    f"r AS (SELECT document_id, CASE WHEN line_no % 2 = 0 THEN 'paragraph' ELSE 'heading' END AS kind, 'P' || (line_no % 6) AS label, start AS a, start + len + CASE WHEN line_no % 9 = 4 THEN 30 ELSE 0 END AS e FROM ({_REGIONS}))",
    _v("Q5", "a", "'out of range'", "r JOIN documents d ON d.doc_id = r.document_id WHERE a < 0 OR e <= a OR e > length(d.text)"),
    _v("Q5", "label", "'label repeated'", "(SELECT document_id, label FROM r GROUP BY 1, 2 HAVING count(*) > 1)"),
    _v("Q5", "a", "'overlap'", "(SELECT *, lag(e) OVER (PARTITION BY document_id, kind ORDER BY a, e) AS b FROM r) WHERE b > a"),
))
def q05_regions(t):
    n = F.col("line_no")
    r = _lines(t).select("document_id", F.when(n % 2 == 0, "paragraph").otherwise("heading").alias("kind"), F.concat(F.lit("P"), (n % 6).cast("string")).alias("label"), "start", (F.col("end") + F.when(n % 9 == 4, 30).otherwise(0)).alias("end"))
    return va.check_q05(r, t.documents.select(F.col("doc_id").alias("document_id"), "text"))


@query(_sql(
    f"r AS (SELECT document_id, line_no, 'P' || (line_no + 1) AS label, start AS a, start + len AS e FROM ({_REGIONS})), c AS (SELECT document_id, line_no AS claim_id, CASE WHEN line_no % 8 = 5 THEN 'P999999' ELSE label END AS label, a - CASE WHEN line_no % 6 = 4 THEN 1 ELSE 0 END AS ca, least(e, a + 10) AS ce FROM r), j AS (SELECT c.*, r.a, r.e FROM c LEFT JOIN r ON r.document_id = c.document_id AND r.label = c.label)",
    _v("Q6", "claim_id", "CASE WHEN a IS NULL THEN 'unknown paragraph' ELSE 'outside its paragraph' END", "j WHERE a IS NULL OR ca < a OR ce > e"),
))
def q06_claim_paragraphs(t):
    n = F.col("line_no")
    label = F.concat(F.lit("P"), (n + 1).cast("string"))
    c = _lines(t).select("document_id", n.alias("claim_id"), F.when(n % 8 == 5, "P999999").otherwise(label).alias("paragraph"), (F.col("start") - F.when(n % 6 == 4, 1).otherwise(0)).alias("start"), F.least(F.col("end"), F.col("start") + 10).alias("end"))
    return va.check_q06(c, _lines(t).select("document_id", F.lit("paragraph").alias("kind"), label.alias("label"), "start", "end"))


_EVIDENCE = """e0 AS (SELECT document_id, evidence_id, min(tier) AS tier, min(claim_id) AS c FROM v_links GROUP BY 1, 2), m AS (SELECT document_id, min(evidence_id) AS m FROM e0 GROUP BY 1),
e AS (SELECT e0.*, CASE WHEN c % 3 = 0 THEN 'computation' ELSE 'web' END AS kind, tier <= 2 AS verified, CASE WHEN c % 4 <> 1 THEN 'words' END AS quote, list_filter([CASE WHEN c % 2 = 0 THEN m END, CASE WHEN c % 5 = 0 THEN evidence_id END, CASE WHEN c % 7 = 2 THEN 'EX' END], lambda x: x IS NOT NULL) AS used,
 CASE c % 5 WHEN 0 THEN 'language' WHEN 1 THEN 'verdict' WHEN 2 THEN 'omissions' WHEN 3 THEN 'verify' END AS stage FROM e0 JOIN m ON m.document_id = e0.document_id)"""


def _evidence(t):
    e = t.v_links.groupBy("document_id", "evidence_id").agg(F.min("tier").alias("tier"), F.min("claim_id").alias("c"))
    c = F.col("c")
    first = e.groupBy("document_id").agg(F.min("evidence_id").alias("m"))
    used = F.array_compact(F.array(F.when(c % 2 == 0, F.col("m")), F.when(c % 5 == 0, F.col("evidence_id")), F.when(c % 7 == 2, F.lit("EX"))))
    stage = F.when(c % 5 == 0, "language").when(c % 5 == 1, "verdict").when(c % 5 == 2, "omissions").when(c % 5 == 3, "verify")
    return e.join(first, "document_id").select("document_id", "evidence_id", "tier", F.when(c % 3 == 0, "computation").otherwise("web").alias("kind"), (F.col("tier") <= 2).alias("verified"), F.when(c % 4 != 1, "words").alias("quote"), used.alias("derived_from"), stage.alias("stage"))


@query(_sql(
    _EVIDENCE + ", u AS (SELECT document_id, evidence_id, tier, kind, unnest(used) AS d FROM e), j AS (SELECT u.*, b.tier AS bt FROM u LEFT JOIN e b ON b.document_id = u.document_id AND b.evidence_id = u.d), w AS (SELECT document_id, evidence_id, max(coalesce(bt, 5)) AS worst FROM j GROUP BY 1, 2)",
    _v("Q8", "evidence_id", "'derived from unknown ' || d", "j WHERE bt IS NULL"), _v("Q8", "evidence_id", "'derived from itself'", "u WHERE d = evidence_id"), _v("Q8", "evidence_id", "'verified without a quote'", "e WHERE verified AND quote IS NULL"),
    _v("Q8", "evidence_id", "'better than its inputs'", "(SELECT e.document_id, e.evidence_id, e.tier, worst FROM e LEFT JOIN w ON w.document_id = e.document_id AND w.evidence_id = e.evidence_id WHERE kind = 'computation') WHERE tier < coalesce(worst, 5)", "warning"),
))
def q08_derivations(t):
    return va.check_q08(_evidence(t))


@query(_sql(
    _EVIDENCE + ", s AS (SELECT document_id, claim_id, dimension, CASE (claim_id + document_id) % 5 WHEN 0 THEN 'language' WHEN 1 THEN 'substantiate' WHEN 2 THEN 'verify' WHEN 3 THEN 'consistency' END AS stage FROM v_scores), may(dimension, stage) AS (VALUES ('clarity', 'language'), ('support', 'substantiate'), ('support', 'verify'), ('materiality', 'verify'), ('consistency', 'consistency'))",
    _v("Q9", "evidence_id", "'stage ' || stage", "e WHERE stage NOT IN ('language', 'substantiate', 'verify', 'consistency', 'omissions')"),
    _v("Q9", "claim_id", "'stage ' || stage || ' ' || dimension", "s WHERE stage IS NOT NULL AND NOT EXISTS (SELECT 1 FROM may WHERE may.dimension = s.dimension AND may.stage = s.stage)"),
))
def q09_stages(t):
    k = (F.col("claim_id") + F.col("document_id")) % 5
    stage = F.when(k == 0, "language").when(k == 1, "substantiate").when(k == 2, "verify").when(k == 3, "consistency")
    return va.check_q09(_evidence(t), t.v_scores.withColumn("stage", stage))


_CITED = "x AS (SELECT document_id, claim_id, list_filter([min(evidence_id), CASE WHEN claim_id = 5 THEN 'EX' END], lambda x: x IS NOT NULL) AS ids FROM v_links GROUP BY document_id, claim_id)"


def _cited(t):
    return t.v_links.groupBy(_KEY).agg(F.min("evidence_id").alias("m")).select(*_KEY, F.array_compact(F.array("m", F.when(F.col("claim_id") == 5, F.lit("EX")))).alias("evidence_ids"))


def _lost(rule: str, rows: str) -> str:
    return _v(rule, "claim_id", "'unknown evidence ' || i", f"(SELECT document_id, claim_id, unnest(ids) AS i FROM {rows}) y WHERE NOT EXISTS (SELECT 1 FROM v_links v WHERE v.document_id = y.document_id AND v.evidence_id = y.i)")


@query(_sql(
    _CITED + ", c AS (SELECT document_id, claim_id FROM v_claims WHERE claim_id <> 3), s AS (SELECT v.document_id, v.claim_id, v.dimension, x.ids FROM v_scores v LEFT JOIN x ON x.document_id = v.document_id AND x.claim_id = v.claim_id), d AS (SELECT unnest(['clarity', 'support', 'materiality', 'consistency']) AS dimension)",
    _v("Q10", "claim_id", "'no ' || dimension", "c CROSS JOIN d WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.document_id = c.document_id AND s.claim_id = c.claim_id AND s.dimension = d.dimension)"),
    _v("Q10", "claim_id", "'unknown claim'", "s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document_id = s.document_id AND c.claim_id = s.claim_id)"), _lost("Q10", "s"),
))
def q10_scores_full(t):
    return va.check_q10(t.v_claims.where("claim_id <> 3"), t.v_scores.join(_cited(t), _KEY, "left"), t.v_links)


@query(_sql(
    _CITED + ", c AS (SELECT document_id, claim_id FROM v_claims WHERE claim_id <> 3), v AS (SELECT * FROM x WHERE claim_id <> 6 UNION ALL SELECT * FROM x WHERE claim_id = 4), a AS (SELECT document_id, claim_id + 2 AS claim_id, ids FROM x)",
    _v("Q11", "claim_id", "'unknown claim'", "v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document_id = v.document_id AND c.claim_id = v.claim_id)"), _v("Q11", "claim_id", "'repeated verdict'", "(SELECT document_id, claim_id FROM v GROUP BY 1, 2 HAVING count(*) > 1)"),
    _v("Q11", "claim_id", "'no verdict'", "c WHERE NOT EXISTS (SELECT 1 FROM v WHERE c.document_id = v.document_id AND c.claim_id = v.claim_id)"),
    _v("Q11", "claim_id", "'argument for an unknown claim'", "a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.document_id = a.document_id AND c.claim_id = a.claim_id)"), _lost("Q11", "v"), _lost("Q11", "a"),
))
def q11_arguments(t):
    x = _cited(t)
    return va.check_q11(x.where("claim_id <> 6").unionByName(x.where("claim_id = 4")), t.v_claims.where("claim_id <> 3"), x.withColumn("claim_id", F.col("claim_id") + 2), t.v_links)


@query(_sql(
    """n AS (SELECT document_id, count(*) AS claims, count(*) FILTER (WHERE category = 'supported') AS supported, count(*) FILTER (WHERE category = 'misleading_by_framing') AS framing, count(*) FILTER (WHERE category = 'unsubstantiated') AS unsub, count(*) FILTER (WHERE category = 'contradicted') AS contra FROM v_verdicts GROUP BY 1),
o AS (SELECT document_id, count(*) AS n FROM v_omissions GROUP BY 1), s AS (SELECT n.document_id, supported + CASE WHEN n.document_id % 10 = 3 THEN 1 ELSE 0 END AS supported, framing, unsub, contra, claims + CASE WHEN n.document_id % 7 = 1 THEN 1 ELSE 0 END AS claim_count, coalesce(o.n, 0) * CASE WHEN n.document_id % 8 = 4 THEN 2 ELSE 1 END AS omission_count FROM n LEFT JOIN o ON o.document_id = n.document_id),
i AS (SELECT document_id, claim_id + CASE WHEN document_id % 5 = 2 THEN 1 ELSE 0 END AS rank, CASE WHEN claim_id = 7 THEN 'O9' WHEN claim_id = 2 THEN 'O1' ELSE CAST(claim_id AS VARCHAR) END AS target FROM v_claims), c AS (SELECT document_id, CASE WHEN document_id % 6 = 1 AND claim_id = 2 THEN 'X' ELSE CAST(claim_id AS VARCHAR) END AS target FROM v_claims WHERE claim_id <= 2),
k AS (SELECT document_id, CAST(claim_id AS VARCHAR) AS target FROM v_claims)""",
    *(_v("Q13", f"'{c}'", "'distribution'", f"s JOIN n ON n.document_id = s.document_id WHERE s.{k} <> n.{k}", document="s.document_id") for c, k in (("supported", "supported"), ("misleading_by_framing", "framing"), ("unsubstantiated", "unsub"), ("contradicted", "contra"))),
    _v("Q13", "'claim_count'", "'count'", "s JOIN n ON n.document_id = s.document_id WHERE claim_count <> claims", document="s.document_id"), _v("Q13", "'omission_count'", "'count'", "s LEFT JOIN o ON o.document_id = s.document_id WHERE omission_count <> coalesce(o.n, 0)", document="s.document_id"),
    _v("Q13", "document_id", "'ranks'", "(SELECT document_id FROM i GROUP BY 1 HAVING list_sort(list(rank)) <> range(1, count(*) + 1))"),
    _v("Q13", "target", "'unknown target'", "i WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.document_id = i.document_id AND k.target = i.target) AND NOT EXISTS (SELECT 1 FROM v_omissions q WHERE q.document_id = i.document_id AND q.omission_id = i.target)"),
    _v("Q13", "target", "'credit to no claim'", "c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.document_id = c.document_id AND k.target = c.target)"),
    _v("Q13", "target", "'credit not supported'", "c JOIN v_verdicts v ON v.document_id = c.document_id AND CAST(v.claim_id AS VARCHAR) = c.target WHERE v.category <> 'supported'", "warning", "c.document_id"),
))
def q13_summary_full(t):
    from ..operators.summary import verdict_distribution

    d = F.col("document_id")
    v, claims = settled(verdicts(t).select(*_KEY, "category")), settled(t.v_claims.select(*_KEY))  # read in several places
    s = verdict_distribution(v, ["document_id"]).withColumn("supported", F.col("supported") + F.when(d % 10 == 3, 1).otherwise(0))
    n = claims.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    o = t.v_omissions.groupBy("document_id").agg(F.count(F.lit(1)).alias("o"))
    s = s.join(n, "document_id").join(o, "document_id", "left").withColumn("claim_count", F.col("n") + F.when(d % 7 == 1, 1).otherwise(0)).withColumn("omission_count", F.coalesce("o", F.lit(0)) * F.when(d % 8 == 4, 2).otherwise(1))
    c = F.col("claim_id")
    issues = claims.select("document_id", (c + F.when(d % 5 == 2, 1).otherwise(0)).alias("rank"), F.when(c == 7, "O9").when(c == 2, "O1").otherwise(c.cast("string")).alias("target"))
    credit = claims.where("claim_id <= 2").select("document_id", F.when((d % 6 == 1) & (c == 2), "X").otherwise(c.cast("string")).alias("target"))
    return va.check_q13(s, v, claims, t.v_omissions, issues, credit)


_CATS = ("supported", "misleading_by_framing", "unsubstantiated", "contradicted")
_LISTED = f"""n AS (SELECT document_id, count(*) AS claim_count, {', '.join(f"count(*) FILTER (WHERE claim_id % 4 = {i}) AS {c}" for i, c in enumerate(_CATS))} FROM v_claims GROUP BY 1),
l0 AS (SELECT d.company_id, d.document_id, d.doc_date, n.claim_count, CAST(coalesce(o.k, 0) AS BIGINT) AS omission_count, {', '.join('n.' + c for c in _CATS)}, row_number() OVER (PARTITION BY d.company_id ORDER BY CASE WHEN d.company_id % 8 = 3 THEN NULL ELSE d.doc_date END ASC NULLS FIRST, d.document_id) AS place
 FROM v_documents d JOIN n ON n.document_id = d.document_id LEFT JOIN (SELECT document_id, count(*) AS k FROM v_omissions GROUP BY 1) o ON o.document_id = d.document_id),
l AS (SELECT * FROM l0 UNION ALL SELECT * REPLACE (place + 100000 AS place) FROM l0 WHERE document_id % 50 = 7)"""
_SUMS = ("document_count", "claim_count", "omission_count", *_CATS)


@query(_sql(
    _LISTED + f", g AS (SELECT company_id, count(*) AS document_count, {', '.join(f'sum({c}) AS {c}' for c in _SUMS[1:])} FROM l GROUP BY 1), c AS (SELECT * REPLACE (claim_count + CASE WHEN company_id % 7 = 2 THEN 1 ELSE 0 END AS claim_count, document_count - CASE WHEN company_id % 9 = 5 THEN 1 ELSE 0 END AS document_count) FROM g)",
    _v("Q14", "document_id", "'listed again'", "(SELECT company_id, document_id FROM l GROUP BY 1, 2 HAVING count(*) > 1)", document="company_id"),
    *(_v("Q14", f"'{k}'", "'sum'", f"c JOIN g ON g.company_id = c.company_id WHERE c.{k} <> g.{k}", document="c.company_id") for k in _SUMS),
    _v("Q14", "document_id", "'out of order'", "(SELECT *, coalesce(doc_date, DATE '0001-01-01') AS day, lag(coalesce(doc_date, DATE '0001-01-01')) OVER (PARTITION BY company_id ORDER BY place) AS p FROM l) WHERE p > day", document="company_id"),
))
def q14_company_view(t):
    from pyspark.sql import Window

    n = t.v_claims.groupBy("document_id").agg(F.count(F.lit(1)).alias("claim_count"), *(F.count_if(F.col("claim_id") % 4 == i).alias(c) for i, c in enumerate(_CATS)))
    o = t.v_omissions.groupBy("document_id").agg(F.count(F.lit(1)).alias("omission_count"))
    at = Window.partitionBy("company_id").orderBy(F.when(F.col("company_id") % 8 != 3, F.col("doc_date")).asc_nulls_first(), "document_id")
    l = t.v_documents.join(n, "document_id").join(o, "document_id", "left").fillna(0, ["omission_count"]).withColumn("place", F.row_number().over(at))
    l = l.unionByName(l.where("document_id % 50 = 7").withColumn("place", F.col("place") + 100_000))
    c = l.groupBy("company_id").agg(F.count(F.lit(1)).alias("document_count"), *(F.sum(x).alias(x) for x in _SUMS[1:]))
    k = F.col("company_id")
    c = c.withColumn("claim_count", F.col("claim_count") + F.when(k % 7 == 2, 1).otherwise(0)).withColumn("document_count", F.col("document_count") - F.when(k % 9 == 5, 1).otherwise(0))
    return va.check_q14(c, l)


@query(_sql(
    """d AS (SELECT v.company_id, v.document_id, h.profile, h.score FROM v_documents v JOIN v_header h ON h.document_id = v.document_id), r AS (SELECT company_id, profile, min(score) AS lo, max(score) AS hi, avg(score) AS mean FROM d GROUP BY 1, 2),
c AS (SELECT company_id, profile, lo, hi, mean, mean + CASE WHEN company_id % 9 = 4 THEN 0.5037 WHEN company_id % 9 = 5 THEN -0.2037 ELSE 0 END AS score FROM r), s AS (SELECT company_id, score, 1e0 / count(*) OVER (PARTITION BY company_id) + CASE WHEN company_id % 6 = 1 THEN 0.1 ELSE 0 END AS share FROM d WHERE profile = 'headline')""",
    _v("Q15", "profile", "'out of range'", "c WHERE score < lo - 0.011 OR score > hi + 0.011", document="company_id"), _v("Q15", "profile", "'below mean'", "c WHERE profile = 'headline' AND score < mean - 0.011", "warning", "company_id"),
    _v("Q15", "company_id", "'shares'", "(SELECT company_id FROM s GROUP BY 1 HAVING abs(sum(share) - CASE WHEN max(score) > 0 THEN 1 ELSE 0 END) > 0.02)", document="company_id"),
))
def q15_company_ranges(t):
    from pyspark.sql import Window

    k = F.col("company_id")
    d = settled(t.v_documents.join(header(t), "document_id").select("company_id", "document_id", "profile", "score"))  # read in several places
    c = d.groupBy("company_id", "profile").agg(F.avg("score").alias("score")).withColumn("score", F.col("score") + F.when(k % 9 == 4, 0.5037).when(k % 9 == 5, -0.2037).otherwise(0.0))
    share = 1.0 / F.count(F.lit(1)).over(Window.partitionBy("company_id")) + F.when(k % 6 == 1, 0.1).otherwise(0.0)
    return va.check_q15(c, d, d.where("profile = 'headline'").select("company_id", "score", share.alias("share")))


@query(_sql(
    f"""t0 AS ({_TREND}), d AS (SELECT company_id, document_id, doc_date, score, confidence FROM v_dated WHERE doc_date IS NOT NULL), g AS (SELECT company_id, count(*) AS n, arg_min(document_id, (doc_date, document_id)) AS ai, arg_min(score, (doc_date, document_id)) AS a, arg_min(confidence, (doc_date, document_id)) AS ac, min(doc_date) AS ad,
 arg_max(document_id, (doc_date, document_id)) AS zi, arg_max(score, (doc_date, document_id)) AS z, arg_max(confidence, (doc_date, document_id)) AS zc, max(doc_date) AS zd FROM d GROUP BY 1),
t AS (SELECT t0.company_id AS k, points + CASE WHEN t0.company_id % 5 = 1 THEN 1 ELSE 0 END AS points, change + CASE WHEN t0.company_id % 7 = 3 THEN 0.3 ELSE 0 END AS change, span_days + CASE WHEN t0.company_id % 8 = 2 THEN 1 ELSE 0 END AS span_days, per_year,
 CASE WHEN t0.company_id % 6 = 4 THEN 'worsening' ELSE direction END AS direction, confidence + CASE WHEN t0.company_id % 9 = 1 THEN 0.5 ELSE 0 END AS confidence, CASE WHEN t0.company_id % 10 <> 9 THEN ai END AS fi, a AS fs, zi AS li, z + CASE WHEN t0.company_id % 11 = 5 THEN 0.2 ELSE 0 END AS ls FROM t0 LEFT JOIN g ON g.company_id = t0.company_id),
j AS (SELECT *, coalesce(n, 0) AS m, direction <> 'undetermined' AND coalesce(n, 0) >= 2 AS real FROM t LEFT JOIN g ON g.company_id = t.k), f AS (SELECT *, real AND fi IS NOT NULL AND li IS NOT NULL AS ok FROM j)""",
    _v("Q16", "k", "r", """(SELECT k, unnest(list_filter([CASE WHEN points <> m THEN 'points' END, CASE WHEN direction = 'undetermined' AND m >= 2 THEN 'undetermined on two documents' END, CASE WHEN direction = 'undetermined' AND (change IS NOT NULL OR confidence <> 0) THEN 'undetermined with a change' END,
 CASE WHEN direction <> 'undetermined' AND m < 2 THEN 'direction on one document' END, CASE WHEN real AND (fi IS NULL OR li IS NULL) THEN 'no ends' END, CASE WHEN ok AND (fi <> ai OR abs(fs - a) > 0.011) THEN 'first' END, CASE WHEN ok AND (li <> zi OR abs(ls - z) > 0.011) THEN 'last' END,
 CASE WHEN ok AND abs(change - (ls - fs)) > 0.011 THEN 'change' END, CASE WHEN ok AND span_days <> zd - ad THEN 'span' END, CASE WHEN ok AND ((direction = 'worsening' AND change <= 0) OR (direction = 'improving' AND change >= 0) OR (direction = 'steady' AND abs(change) > 0.1)) THEN 'direction' END,
 CASE WHEN ok AND per_year IS NOT NULL AND span_days = 0 THEN 'pace without time' END, CASE WHEN ok AND confidence > least(ac, zc) + 0.011 THEN 'confidence' END], lambda x: x IS NOT NULL)) AS r FROM f)""", document="k"),
))
def q16_trend(t):
    h = settled(header(t).where("profile = 'headline'").select("document_id", "profile", "score", "confidence"))  # read in several places
    docs = t.v_documents.join(h, "document_id").select("company_id", "document_id", "doc_date", "score", "confidence")
    at = F.struct("doc_date", "document_id")
    ends = docs.where("doc_date is not null").groupBy("company_id").agg(F.min_by(F.struct("document_id", "score"), at).alias("a"), F.max_by(F.struct("document_id", "score"), at).alias("z"))
    k = F.col("company_id")
    tr = co.trend(t.v_documents, h).join(ends, "company_id", "left").select(
        "company_id", (F.col("points") + F.when(k % 5 == 1, 1).otherwise(0)).alias("points"), (F.col("change") + F.when(k % 7 == 3, 0.3).otherwise(0.0)).alias("change"), (F.col("span_days") + F.when(k % 8 == 2, 1).otherwise(0)).alias("span_days"), "per_year",
        F.when(k % 6 == 4, "worsening").otherwise(F.col("direction")).alias("direction"), (F.col("confidence") + F.when(k % 9 == 1, 0.5).otherwise(0.0)).alias("confidence"), F.when(k % 10 != 9, F.col("a.document_id")).alias("first_id"), F.col("a.score").alias("first_score"),
        F.col("z.document_id").alias("last_id"), (F.col("z.score") + F.when(k % 11 == 5, 0.2).otherwise(0.0)).alias("last_score"))
    return va.check_q16(tr, docs)


@query(_sql(
    "g AS (SELECT analysis_id, entity_id, count(*) FILTER (WHERE type = 'stage.started') AS s, count(*) FILTER (WHERE type = 'stage.completed') AS c, min(seq) FILTER (WHERE type = 'stage.started') AS a, min(seq) FILTER (WHERE type = 'stage.completed') AS b FROM v_log WHERE type IN ('stage.started', 'stage.completed') GROUP BY 1, 2), need(stage, before) AS (VALUES (2, 1), (5, 3), (5, 4), (9, 9))",
    _v("Q17", "entity_id", "d", "(SELECT analysis_id, entity_id, unnest(list_filter([CASE WHEN s = 0 THEN 'not started' END, CASE WHEN s > 1 THEN 'started again' END, CASE WHEN c = 0 THEN 'not closed' END, CASE WHEN c > 1 THEN 'closed again' END, CASE WHEN b < a THEN 'closed first' END], lambda x: x IS NOT NULL)) AS d FROM g)", document="analysis_id"),
    _v("Q17", "g.entity_id", "'before ' || before", "g JOIN need ON need.stage = g.entity_id LEFT JOIN g h ON h.analysis_id = g.analysis_id AND h.entity_id = need.before WHERE g.a IS NOT NULL AND (h.b IS NULL OR h.b > g.a)", document="g.analysis_id"),
))
def q17_prerequisites(t):
    return va.check_q17(t.v_log, {2: (1,), 5: (3, 4), 9: (9,)})


@query(_sql(
    """o(type, stage) AS (VALUES ('claim.extracted', 1), ('claim.extracted', 2), ('evidence.added', 3)), b AS (SELECT analysis_id, entity_id, seq, type, min(CASE WHEN type = 'stage.completed' THEN seq END) OVER (PARTITION BY analysis_id, entity_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS done FROM v_log WHERE type IN ('stage.started', 'stage.completed')),
d AS (SELECT analysis_id, entity_id, min(seq) AS t0 FROM v_log WHERE type = 'claim.extracted' GROUP BY 1, 2)""",
    _v("Q18", "seq", "type || ' outside its stage'", "v_log e WHERE type IN (SELECT type FROM o) AND NOT EXISTS (SELECT 1 FROM o JOIN b ON b.entity_id = o.stage WHERE o.type = e.type AND b.type = 'stage.started' AND b.analysis_id = e.analysis_id AND b.seq < e.seq AND (b.done IS NULL OR b.done > e.seq))", document="analysis_id"),
    _v("Q18", "u.seq", "CASE WHEN t0 IS NULL THEN 'never defined ' ELSE 'used before ' END || u.entity_id", "v_log u LEFT JOIN d ON d.analysis_id = u.analysis_id AND d.entity_id = u.entity_id WHERE u.type = 'evidence.added' AND (t0 IS NULL OR t0 >= u.seq)", document="u.analysis_id"),
))
def q18_event_order(t):
    owners = t.v_log.sparkSession.createDataFrame([("claim.extracted", 1), ("claim.extracted", 2), ("evidence.added", 3)], "type string, stage long")
    log = t.v_log
    return va.check_q18(log, owners, log.where("type = 'evidence.added'").select("analysis_id", "seq", F.col("entity_id").alias("ref")), log.where("type = 'claim.extracted'").select("analysis_id", "seq", F.col("entity_id").alias("id")))


@query(_sql(
    """v AS (SELECT analysis_id, seq, entity_id % 3 AS c FROM v_log WHERE type = 'stage.completed'), s AS (SELECT analysis_id, seq, entity_id % 3 AS c, entity_id % 4 AS d FROM v_log WHERE type = 'dimension.scored'), f AS (SELECT analysis_id, count(*) AS n FROM v_log WHERE type = 'stage.started' AND entity_id % 7 = 0 GROUP BY 1),
n AS (SELECT analysis_id, count(*) AS events, count(*) FILTER (WHERE type = 'claim.extracted') AS claims FROM v_log GROUP BY 1), k AS (SELECT analysis_id, events + CASE WHEN analysis_id % 5 = 2 THEN 1 ELSE 0 END AS events, claims + CASE WHEN analysis_id % 6 = 1 THEN 1 ELSE 0 END AS claims FROM n)""",
    _v("Q19", "c", "'verdict before its scores'", "v WHERE (SELECT count(DISTINCT d) FROM s WHERE s.analysis_id = v.analysis_id AND s.c = v.c AND s.seq < v.seq) < 4", document="analysis_id"),
    _v("Q19", "k.analysis_id", "coalesce(f.n, 0) || ' final summaries'", "k LEFT JOIN f ON f.analysis_id = k.analysis_id WHERE coalesce(f.n, 0) <> 1", document="k.analysis_id"),
    _v("Q19", "'events'", "'count'", "k JOIN n ON n.analysis_id = k.analysis_id WHERE k.events <> n.events", document="k.analysis_id"), _v("Q19", "'claims'", "'count'", "k JOIN n ON n.analysis_id = k.analysis_id WHERE k.claims <> n.claims", document="k.analysis_id"),
))
def q19_completion(t):
    log, e = t.v_log, F.col("entity_id")
    counted = log.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("type") == "claim.extracted").alias("claims"))
    a = F.col("analysis_id")
    said = counted.select("analysis_id", (F.col("events") + F.when(a % 5 == 2, 1).otherwise(0)).alias("events"), (F.col("claims") + F.when(a % 6 == 1, 1).otherwise(0)).alias("claims"))
    v = log.where("type = 'stage.completed'").select("analysis_id", "seq", (e % 3).alias("claim_id"))
    s = log.where("type = 'dimension.scored'").select("analysis_id", "seq", (e % 3).alias("claim_id"), (e % 4).alias("dimension"))
    return va.check_q19(v, s, log.where((F.col("type") == "stage.started") & (e % 7 == 0)).select("analysis_id", "seq"), said, counted)


# -- the rest of the log's fold ------------------------------------------------------------------


@query("SELECT analysis_id, entity_id, string_agg(seq, ',' ORDER BY seq) AS seqs, count(*) AS n FROM v_log WHERE type = 'evidence.added' GROUP BY 1, 2")
def a33_arguments(t):
    from ..operators import eventlog as ev

    out = ev.fold_arguments(t.v_log, "evidence.added")
    return out.select("analysis_id", "entity_id", F.array_join(F.transform("arguments", lambda x: x["seq"].cast("string")), ",").alias("seqs"), F.size("arguments").cast("long").alias("n"))


@query("SELECT analysis_id, entity_id, seq % 4 AS dimension, max(seq) AS seq, arg_max(payload, seq) AS payload FROM v_log WHERE type = 'dimension.scored' GROUP BY 1, 2, 3")
def a33_scores(t):
    from ..operators import eventlog as ev

    return ev.fold_scores(t.v_log.withColumn("dimension", F.col("seq") % 4))


@query("SELECT analysis_id, max(seq) AS seq, arg_max(payload, seq) AS payload FROM v_log WHERE type = 'stage.started' GROUP BY 1")
def a33_summary(t):
    from ..operators import eventlog as ev

    return ev.fold_summary(t.v_log, "stage.started")


_SIG = """s AS (SELECT document_id, claim_id AS id, CASE s % 3 WHEN 0 THEN 'hedge' WHEN 1 THEN 'vague_term' ELSE 'ratio' END AS kind, CASE WHEN p % 5 = 0 THEN 'document' ELSE 'claim' END AS level, s % 40 AS a, s % 40 + 4 + p % 9 AS b, claim_id % 3 AS c FROM v_base),
l AS (SELECT * FROM s WHERE id <> 6), r AS (SELECT document_id, id, CASE WHEN id % 4 = 3 THEN 'hedge' ELSE kind END AS kind, level, a + id % 3 * 2 AS a, b + id % 3 * 2 AS b, c FROM s WHERE id <> 2)"""


@query(f"""WITH RECURSIVE {_SIG}, q AS (SELECT l.document_id, l.id AS live_id, r.id AS ref_id, l.level = 'document' AND r.level = 'document' OR l.c = r.c AS near, CAST(greatest(0, least(l.b, r.b) - greatest(l.a, r.a)) AS DOUBLE) / least(l.b - l.a, r.b - r.a) AS share FROM l JOIN r ON r.document_id = l.document_id AND r.kind = l.kind),
p AS (SELECT document_id, live_id, ref_id, CASE WHEN share >= 0.5 THEN 'span' ELSE 'claim' END AS how, row_number() OVER (PARTITION BY document_id ORDER BY share < 0.5, CASE WHEN share >= 0.5 THEN share ELSE 0 END DESC, live_id, ref_id) AS k FROM q WHERE share >= 0.5 OR near),
w AS (SELECT document_id, 0::BIGINT AS k, 0::BIGINT AS x, 0::BIGINT AS y, false AS took FROM (SELECT DISTINCT document_id FROM p)
 UNION ALL SELECT w.document_id, p.k, CASE WHEN free THEN w.x | (1 << p.live_id) ELSE w.x END, CASE WHEN free THEN w.y | (1 << p.ref_id) ELSE w.y END, free FROM w JOIN p ON p.document_id = w.document_id AND p.k = w.k + 1, LATERAL (SELECT (w.x & (1 << p.live_id)) = 0 AND (w.y & (1 << p.ref_id)) = 0 AS free))
SELECT p.document_id, p.live_id, p.ref_id, p.how FROM w JOIN p ON p.document_id = w.document_id AND p.k = w.k WHERE w.took""")
def j7_match_signals(t):
    from ..operators import matching as ma

    c, s, p = F.col("claim_id"), F.col("s"), F.col("p")
    x = t.v_base.select("document_id", c.alias("id"), F.when(s % 3 == 0, "hedge").when(s % 3 == 1, "vague_term").otherwise("ratio").alias("kind"), F.when(p % 5 == 0, "document").otherwise("claim").alias("level"), (s % 40).alias("a"), (s % 40 + 4 + p % 9).alias("b"), F.array(c % 3).alias("claim_ids"))
    spans = lambda d: F.array(F.struct((F.col("a") + d).alias("start"), (F.col("b") + d).alias("end"))).alias("spans")
    live = x.where("id <> 6").select("document_id", "id", "kind", "level", "claim_ids", spans(F.lit(0)))
    ref = x.where("id <> 2").select("document_id", "id", F.when(F.col("id") % 4 == 3, "hedge").otherwise(F.col("kind")).alias("kind"), "level", "claim_ids", spans(F.col("id") % 3 * 2))
    return ma.match_signals(live, ref)
