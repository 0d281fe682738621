"""Queries of spans, matching, comparison, knowledge and block operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import blocks as bl
from ..operators import knowledge as kn
from ..operators import matching as ma
from ..operators import ordering as od
from ..operators import spans as sp
from ..operators import verdict as ve
from ..sources import pages as pg
from .queries_audit import header, verdicts
from .registry import query
from ..scratch import settled

_KEY = ["document_id", "claim_id"]


def _r(c, n=None):
    return ve.rounded(F.col(c) if isinstance(c, str) else c, 6).alias(n or c)


# -- spans and quotes ------------------------------------------------------------------------

_REGIONS = """SELECT doc_id AS document_id, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(line) AS len, line
FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"""
_PLACED = "SELECT d.doc_id AS document_id, b.item_id AS owner_id, instr(d.text, regexp_replace(b.text, '[.;:,]+$', '')) - 1 AS start, length(regexp_replace(b.text, '[.;:,]+$', '')) AS len FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND NOT contains(b.text, chr(10))"


# Spark's class of white space and the squashing of texts, for DuckDB
_BLANK = tx.SPACE.replace(r"\u0085", r"\x{85}\x0b")


def _squashed_sql(c):
    return f"lower(trim(regexp_replace(translate({c}, '{_quoted(tx.SQUASH_FROM)}', '{_quoted(tx.SQUASH_TO)}'), '{_BLANK}+', ' ', 'g')))"


def _quoted(s):
    return s.replace("'", "''")


def _plain_sql(c):
    return f"translate({c}, '{_quoted(tx.NORMAL_FROM)}', '{_quoted(tx.NORMAL_TO)}')"


# the whole rule of locate_quotes: pairs by squashed texts; four forms, each as it is, made plain, in lower case; first place not taken
_LOCATED = f"""WITH RECURSIVE lq AS MATERIALIZED (SELECT item_id, trim(regexp_replace(text, '{_BLANK}+', ' ', 'g')) AS quote, {_squashed_sql('text')} AS q FROM benchmark), ld AS MATERIALIZED (SELECT doc_id, text, {_squashed_sql('text')} AS t FROM documents),
lp AS MATERIALIZED (SELECT doc_id, item_id, text, quote, regexp_replace(quote, '^["''“”‘’]+|["''“”‘’]+$', '', 'g') AS bare FROM ld JOIN lq ON q <> '' AND contains(t, q)),
lf AS (SELECT doc_id, item_id, text, unnest([regexp_replace(quote, '[.;:,]+$', ''), quote, regexp_replace(bare, '[.;:,]+$', ''), bare]) AS form, unnest([0, 3, 6, 9]) AS turn FROM lp),
la AS (SELECT doc_id, item_id, unnest([text, {_plain_sql('text')}, lower({_plain_sql('text')})]) AS hay, unnest([form, {_plain_sql('form')}, lower({_plain_sql('form')})]) AS needle, unnest([turn, turn + 1, turn + 2]) AS turn FROM lf WHERE form <> ''),
lb AS (SELECT * FROM la WHERE contains(hay, needle) QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY turn) = 1),
lh AS MATERIALIZED (SELECT doc_id, item_id, length(needle) AS n, list_filter(range(0, length(hay)), lambda i: substr(hay, i + 1, length(needle)) = needle) AS hits, row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS k FROM lb),
ls AS (SELECT doc_id, item_id, k, n, hits[1] AS start, [struct_pack(s := hits[1], e := hits[1] + n)] AS taken FROM lh WHERE k = 1
 UNION ALL SELECT h.doc_id, h.item_id, h.k, h.n, o.at, list_append(b.taken, struct_pack(s := o.at, e := o.at + h.n)) FROM ls b JOIN lh h ON h.doc_id = b.doc_id AND h.k = b.k + 1,
  LATERAL (SELECT coalesce(list_filter(h.hits, lambda x: len(list_filter(b.taken, lambda y: x < y.e AND x + h.n > y.s)) = 0)[1], h.hits[1]) AS at) o)
SELECT doc_id AS document_id, item_id AS owner_id, start, n AS len FROM ls"""


def _pairs(t):
    got = sp.find_quotes(t.benchmark, t.documents)
    d = t.documents.select("doc_id", "text")
    return got.join(d, "doc_id").join(t.benchmark.select("item_id", F.col("text").alias("quote")), "item_id").select(F.col("doc_id").alias("document_id"), F.col("item_id").alias("owner_id"), "quote", "text")


def _placed(t):
    return settled(sp.locate_quotes(_pairs(t))).where("start is not null").select("document_id", "owner_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def _regions(t):
    return sp.line_regions(t.documents).select("document_id", F.lit("paragraph").alias("kind"), F.concat(F.lit("P"), (F.col("line_no") + 1).cast("string")).alias("label"), "start", "end", F.when(F.col("line_no") == 0, 1.0).otherwise(0.6).alias("prominence"), "line_no")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))))")
def j9_find_quotes(t):
    return sp.find_quotes(t.benchmark, t.documents)


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g'))))")
def j9_find_quotes_long_list(t):
    """Each quote twice, with a number of its own: a list that grows with the table joins by the same shingles."""
    twice = t.benchmark.select((F.col("item_id") * 2).alias("k"), "text").unionByName(t.benchmark.select((F.col("item_id") * 2 + 1).alias("k"), "text"))
    return sp.find_quotes(twice, t.documents, "k").select("doc_id", F.floor(F.col("k") / 2).alias("item_id")).distinct()


@query(f"SELECT document_id, owner_id, start, start + len AS \"end\" FROM ({_LOCATED})")
def j10_locate_quotes(t):
    return _placed(t)


@query(f"""SELECT p.document_id, p.owner_id, 'P' || (r.line_no + 1) AS paragraph, CASE WHEN r.line_no IS NULL THEN NULL WHEN r.line_no = 0 THEN 1.0 ELSE 0.6 END AS prominence FROM ({_LOCATED}) p
LEFT JOIN ({_REGIONS}) r ON r.document_id = p.document_id AND r.start <= p.start AND p.start + p.len <= r.start + r.len""")
def j4_locate_region(t):
    return sp.locate_region(_placed(t), _regions(t)).select("document_id", "owner_id", "paragraph", "prominence")


@query(f"""WITH p AS ({_LOCATED}), r AS ({_REGIONS}), x AS (SELECT p.document_id, p.owner_id AS a_id, r.line_no AS b_id, greatest(0, least(p.start + p.len, r.start + r.len) - greatest(p.start, r.start)) / least(p.len, r.len) AS share
 FROM p JOIN r ON r.document_id = p.document_id AND r.start < p.start + p.len AND p.start < r.start + r.len) SELECT document_id, a_id, b_id, round(share, 6) AS share FROM x WHERE share >= 0.5""")
def j5_overlap_pairs(t):
    out = ma.overlap_pairs(_placed(t), _regions(t).withColumn("owner_id", F.col("line_no")))
    return out.select("document_id", "a_id", "b_id", _r("share"))




@query("""WITH RECURSIVE x AS (SELECT document_id, claim_id, claim_id * 7 % 5 AS a FROM v_claims),
p AS (SELECT x.document_id, x.claim_id, y.claim_id AS other, abs(x.a - y.a) AS gap, row_number() OVER (PARTITION BY x.document_id ORDER BY abs(x.a - y.a), x.claim_id, y.claim_id) AS k
 FROM x JOIN x y ON y.document_id = x.document_id WHERE abs(x.a - y.a) <= 1 AND x.claim_id <> y.claim_id),
s AS (SELECT document_id, 0::BIGINT AS k, 0::BIGINT AS l, 0::BIGINT AS r, false AS took FROM (SELECT DISTINCT document_id FROM p)
 UNION ALL SELECT s.document_id, p.k, CASE WHEN free THEN s.l | (1 << p.claim_id) ELSE s.l END, CASE WHEN free THEN s.r | (1 << p.other) ELSE s.r END, free
 FROM s JOIN (SELECT *, true AS one FROM p) p ON p.document_id = s.document_id AND p.k = s.k + 1, LATERAL (SELECT (s.l & (1 << p.claim_id)) = 0 AND (s.r & (1 << p.other)) = 0 AS free))
SELECT p.document_id, p.claim_id, p.other, p.gap FROM s JOIN p ON p.document_id = s.document_id AND p.k = s.k WHERE s.took""")
def j6_greedy_match(t):
    """Claims on both sides of a shift matched one to one."""
    x = t.v_claims.select("document_id", "claim_id", (F.col("claim_id") * 7 % 5).alias("a"))
    pairs = x.join(x.select("document_id", F.col("claim_id").alias("other"), F.col("a").alias("b")), "document_id").withColumn("gap", F.abs(F.col("a") - F.col("b"))).where("gap <= 1 and claim_id <> other")
    return ma.greedy_match(pairs, [F.col("gap"), F.col("claim_id"), F.col("other")], ["document_id", "claim_id"], ["document_id", "other"]).select("document_id", "claim_id", "other", "gap")


@query(f"""SELECT document_id, owner_id, CASE WHEN owner_id % 3 = 0 THEN start WHEN owner_id % 3 = 1 THEN start + 5 ELSE start + 5 END AS new_start, CASE WHEN owner_id % 3 = 0 THEN 'offset' WHEN owner_id % 3 = 1 THEN 'unique' ELSE 'occurrence' END AS method
FROM (SELECT document_id, owner_id, start FROM ({_PLACED}) p JOIN documents d ON d.doc_id = p.document_id JOIN benchmark b ON b.item_id = p.owner_id WHERE len(string_split(d.text, regexp_replace(b.text, '[.;:,]+$', ''))) = 2)""")
def j13_reanchor(t):
    p = settled(sp.locate_quotes(_pairs(t))).where("start is not null and occurrence is null")
    moved = F.col("owner_id") % 3 != 0
    rows = p.select("document_id", "owner_id", F.col("found").alias("needle"), F.when(moved, F.concat(F.lit("xxxx "), "text")).otherwise(F.col("text")).alias("text"), "start", "end", F.lit(None).cast("string").alias("context"), F.when(F.col("owner_id") % 3 == 2, 1).alias("occurrence"), F.col("text").alias("old_text"))
    return sp.reanchor(rows).select("document_id", "owner_id", F.col("new_start").cast("long").alias("new_start"), "method")


@query(f"""SELECT document_id, owner_id, CASE WHEN owner_id % 4 = 0 THEN 'not_found' WHEN owner_id % 4 = 1 THEN 'occurrence_too_high' END AS reason FROM ({_PLACED}) p JOIN documents d ON d.doc_id = p.document_id JOIN benchmark b ON b.item_id = p.owner_id WHERE len(string_split(d.text, regexp_replace(b.text, '[.;:,]+$', ''))) = 2""")
def q23_span_report(t):
    p = settled(sp.locate_quotes(_pairs(t))).where("start is not null and occurrence is null")
    rows = p.select("document_id", "owner_id", "text", F.when(F.col("owner_id") % 4 == 0, "no such words").otherwise(F.col("found")).alias("needle"), F.lit(None).cast("string").alias("context"), F.when(F.col("owner_id") % 4 == 1, 9).alias("occurrence"))
    return sp.span_report(rows).select("document_id", "owner_id", "reason")


@query(f"""SELECT p.document_id, p.owner_id AS signal_id, r.line_no AS claim_id FROM ({_LOCATED}) p LEFT JOIN ({_REGIONS}) r ON r.document_id = p.document_id AND r.start <= p.start AND p.start + p.len <= r.start + r.len""")
def j12_attach_orphans(t):
    s = _placed(t).withColumnRenamed("owner_id", "signal_id")
    c = _regions(t).select("document_id", F.col("line_no").alias("claim_id"), "start", "end")
    return sp.attach_orphans(s, c).select("document_id", "signal_id", F.col("claim_id").cast("double").alias("claim_id"))


_SIGNALS = "SELECT doc_id AS document_id, text, CASE doc_id % 3 WHEN 0 THEN 'the ' WHEN 1 THEN 'in' ELSE 'de' END AS needle FROM documents"


@query(f"""WITH r AS ({_REGIONS}), s AS ({_SIGNALS}), h AS (SELECT document_id, needle, unnest(list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(needle)) = needle)) AS start FROM s),
c AS (SELECT document_id, start AS c0, start + least(len, 40) AS c1, start AS p0, start + len AS p1 FROM r WHERE line_no = 1),
x AS (SELECT h.document_id, h.start, h.start + length(needle) AS e, CASE WHEN c0 <= h.start AND h.start + length(needle) <= c1 THEN 1 WHEN p0 <= h.start AND h.start + length(needle) <= p1 THEN 2 ELSE 3 END AS tier FROM h LEFT JOIN c ON c.document_id = h.document_id),
b AS (SELECT *, min(tier) OVER (PARTITION BY document_id) AS best, row_number() OVER (PARTITION BY document_id, tier ORDER BY start) AS k FROM x)
SELECT document_id, CAST(start AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", tier FROM b WHERE tier = best AND (tier = 1 OR k = 1)""")
def j11_signal_tiers(t):
    """All three tiers: a claim is the first 40 characters of the second line, whose whole is its paragraph."""
    lines = sp.line_regions(t.documents)
    needle = F.when(F.col("doc_id") % 3 == 0, "the ").when(F.col("doc_id") % 3 == 1, "in").otherwise("de")
    s = t.documents.select(F.col("doc_id").alias("document_id"), F.lit("L1").alias("signal_id"), F.lit(1).alias("claim_id"), needle.alias("needle"), "text")
    c = lines.where("line_no = 1").select("document_id", F.lit(1).alias("claim_id"), "start", F.least(F.col("end"), F.col("start") + 40).alias("end"))
    out = sp.place_signals(s, c, lines.where("line_no = 1").select("document_id", "start", "end"))
    return out.select("document_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "tier")


@query("""WITH d AS (SELECT doc_id, text, regexp_extract(text, '[A-Za-z]{5,}') AS w FROM documents),
h AS (SELECT doc_id, w, list_filter(range(0, length(text)), lambda i: substr(text, i + 1, length(w)) = w) AS hits FROM d WHERE length(w) >= 5),
g AS (SELECT doc_id, w, list_reduce(list_prepend([]::BIGINT[], [CASE WHEN true THEN [x] END FOR x IN hits]), lambda a, x: CASE WHEN len(a) = 0 OR x[1] >= a[-1] + length(w) THEN a || x ELSE a END) AS firsts, hits FROM h)
SELECT doc_id AS document_id, k AS owner_id, CAST(CASE WHEN k <= len(firsts) THEN firsts[k] ELSE hits[1] END AS BIGINT) AS start FROM g, (SELECT unnest([1, 2, 3]) AS k)""")
def j10_quotes_not_taken(t):
    """Three equal quotes of each document (its first word of five letters): each takes the first place that overlaps none taken."""
    word = F.regexp_extract("text", "[A-Za-z]{5,}", 0)
    pairs = t.documents.where(F.length(word) >= 5).select(F.col("doc_id").alias("document_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("owner_id"), word.alias("quote"), "text")
    return sp.locate_quotes(pairs).select("document_id", F.col("owner_id").cast("int").alias("owner_id"), F.col("start").cast("long").alias("start"))


@query(f"""WITH r AS ({_REGIONS}), d AS (SELECT doc_id, text FROM documents), n AS (SELECT r.document_id, r.line_no, r.start, r.len, instr(r.line, 'the') AS a0, instr(d.text, 'the') AS f0 FROM r JOIN d ON d.doc_id = r.document_id WHERE r.line_no = 0 AND instr(d.text, 'the') > 0)
SELECT document_id, count(*) AS n FROM (SELECT n.document_id, unnest(CASE WHEN a0 > 0 THEN range(0, len(string_split(r.line, 'the')) - 1) ELSE [0] END) FROM n JOIN r ON r.document_id = n.document_id AND r.line_no = 0) GROUP BY 1""")
def j11_place_signals(t):
    c = _regions(t).where("line_no = 0").select("document_id", F.lit(1).alias("claim_id"), "start", "end")
    s = t.documents.select(F.col("doc_id").alias("document_id"), F.lit("L1").alias("signal_id"), F.lit(1).alias("claim_id"), F.lit("the").alias("needle"), "text")
    return sp.place_signals(s, c).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT l_orderkey AS document_id, l_linenumber AS mark_id, min(l_suppkey % 40) AS s, min(l_suppkey % 40 + 5 + l_partkey % 9) AS e FROM lineitem GROUP BY 1, 2), c AS (SELECT DISTINCT document_id, unnest([s, e]) AS a FROM m),
p AS (SELECT document_id, a, lead(a) OVER (PARTITION BY document_id ORDER BY a) AS nxt FROM c) SELECT p.document_id, p.a AS start, p.nxt AS "end", string_agg(CAST(mark_id AS VARCHAR), ',' ORDER BY e - s DESC, mark_id) AS marks FROM p JOIN m ON m.document_id = p.document_id AND m.s <= p.a AND p.nxt <= m.e WHERE nxt IS NOT NULL GROUP BY 1, 2, 3""")
def w20_segments(t):
    m = t.lineitem.groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("mark_id")).agg(F.min(F.col("l_suppkey") % 40).alias("start"), F.min(F.col("l_suppkey") % 40 + 5 + F.col("l_partkey") % 9).alias("end"))
    return sp.segments(m).withColumn("marks", F.array_join(F.transform("marks", lambda x: x.cast("string")), ","))


# -- comparison ----------------------------------------------------------------------------------


def _shifted(t):
    return t.v_scores.withColumn("score", F.when(F.col("claim_id") % 3 == 0, F.greatest(F.lit(0.0), F.round(F.col("score") - 0.1, 2))).otherwise(F.col("score"))).where("claim_id <> 5")


_LIVE = "SELECT document_id, claim_id, dimension, CASE WHEN claim_id % 3 = 0 THEN greatest(0e0, round(score - 0.1, 2)) ELSE score END AS score, confidence FROM v_scores WHERE claim_id <> 5"
_CMP = f"SELECT r.document_id, r.claim_id, r.dimension, r.score AS ref, l.score AS live, abs(l.score - r.score) AS diff, (l.score >= 0.6) <> (r.score >= 0.6) AS crosses FROM v_scores r LEFT JOIN ({_LIVE}) l ON l.document_id = r.document_id AND l.claim_id = r.claim_id AND l.dimension = r.dimension"


def _compared(t):
    return ma.compare_scores(_shifted(t), t.v_scores, [*_KEY, "dimension"])


@query(f"SELECT document_id, claim_id, dimension, ref, live, round(diff, 6) AS diff, crosses FROM ({_CMP})")
def j23_compare_scores(t):
    return _compared(t).withColumn("diff", _r("diff"))


@query(f"SELECT dimension, count(live) AS n, round(avg(diff), 6) AS mae, count(*) FILTER (WHERE crosses) AS crossing, count(*) FILTER (WHERE live IS NULL) AS unscored FROM ({_CMP}) GROUP BY 1")
def a22_agreement(t):
    return ma.agreement(_compared(t), ["dimension"]).withColumn("mae", _r("mae"))


@query(f"SELECT round(avg(abs(live - ref)), 6) AS mae, round(avg(live - ref), 6) AS bias, round(max(abs(live - ref)), 6) AS worst, round(avg(CASE WHEN live IS NULL THEN NULL WHEN abs(live - ref) <= 0.1 + 1e-9 THEN 1e0 ELSE 0e0 END), 6) AS within FROM ({_CMP})")
def a23_formula_report(t):
    out = ma.formula_report(_compared(t), "live", "ref")
    return out.select(*(_r(c) for c in out.columns))


@query("""WITH x AS (SELECT document_id, list(DISTINCT claim_id) FILTER (WHERE score > 0.3) AS a, list(DISTINCT claim_id) FILTER (WHERE confidence > 0.6) AS b FROM v_scores GROUP BY 1)
SELECT CAST(sum(len(list_intersect(coalesce(a, []), coalesce(b, [])))) AS BIGINT) AS "both", CAST(sum(len(coalesce(a, [])) - len(list_intersect(coalesce(a, []), coalesce(b, [])))) AS BIGINT) AS only_left, CAST(sum(len(coalesce(b, [])) - len(list_intersect(coalesce(a, []), coalesce(b, [])))) AS BIGINT) AS only_right FROM x""")
def a24_tag_overlap(t):
    x = t.v_scores.groupBy("document_id").agg(F.collect_set(F.when(F.col("score") > 0.3, F.col("claim_id"))).alias("a"), F.collect_set(F.when(F.col("confidence") > 0.6, F.col("claim_id"))).alias("b"))
    return ma.tag_overlap(x, "a", "b")


@query("""WITH l AS (SELECT document_id, claim_id, type FROM v_claims WHERE claim_id <> 5), m AS (SELECT count(*) AS k, count(*) FILTER (WHERE l.type = r.type) AS s FROM v_claims r JOIN l ON l.document_id = r.document_id AND l.claim_id = r.claim_id + 1)
SELECT k AS matched, round(k / (SELECT count(*) FROM v_claims), 6) AS recall, round(k / (SELECT count(*) FROM l), 6) AS precision, round(s / k, 6) AS type_agreement FROM m""")
def a25_match_quality(t):
    live = t.v_claims.where("claim_id <> 5")
    m = t.v_claims.select("document_id", (F.col("claim_id") + 1).alias("claim_id"), F.col("type").alias("ref_type")).join(live.select(*_KEY, F.col("type").alias("live_type")), _KEY)
    return ma.match_quality(m, live, t.v_claims).select("matched", _r("recall"), _r("precision"), _r("type_agreement"))


@query("SELECT document_id, round(avg(abs(d)), 6) AS mae, count(*) AS n FROM (SELECT document_id, score - CASE WHEN document_id % 2 = 0 THEN score * 0.9 ELSE score END AS d FROM v_header) GROUP BY 1")
def a26_compare_summaries(t):
    h = header(t)
    b = h.withColumn("score", F.when(F.col("document_id") % 2 == 0, F.col("score") * 0.9).otherwise(F.col("score")))
    return ma.compare_summaries(h, b, ["document_id"]).withColumn("mae", _r("mae"))


@query("""WITH a AS (SELECT DISTINCT document_id, claim_id FROM v_links WHERE relation LIKE 'contradicts%' AND tier <= 3), b AS (SELECT DISTINCT document_id, claim_id FROM v_links WHERE relation LIKE 'contradicts%' AND tier >= 3)
SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.claim_id, b.claim_id) AS claim_id, CASE WHEN a.document_id IS NULL THEN 'missed' WHEN b.document_id IS NULL THEN 'extra' ELSE 'agreed' END AS side FROM a FULL JOIN b ON a.document_id = b.document_id AND a.claim_id = b.claim_id""")
def a27_compare_contradictions(t):
    return ma.compare_contradictions(t.v_links.where("tier <= 3"), t.v_links.where("tier >= 3"), _KEY)


@query("""WITH l AS (SELECT document_id, claim_id, relation, list(DISTINCT evidence_id) AS u FROM v_links WHERE tier <= 4 GROUP BY 1, 2, 3), r AS (SELECT document_id, claim_id, relation, list(DISTINCT evidence_id) AS u FROM v_links WHERE tier >= 2 GROUP BY 1, 2, 3)
SELECT r.document_id, r.claim_id, r.relation, l.u IS NOT NULL AS found, coalesce(list_has_any(l.u, r.u), false) AS same_url FROM r LEFT JOIN l ON l.document_id = r.document_id AND l.claim_id = r.claim_id AND l.relation = r.relation""")
def j24_compare_links(t):
    x = t.v_links.withColumn("url", F.col("evidence_id"))
    return ma.compare_links(x.where("tier <= 4"), x.where("tier >= 2"))


@query(r"""WITH h AS (SELECT page_id, page_id % 10 AS k, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages), a AS (SELECT DISTINCT k, host FROM h WHERE page_id % 3 <> 0), b AS (SELECT DISTINCT k, host FROM h WHERE page_id % 4 <> 1)
SELECT b.k, count(*) AS n_hosts, count(a.host) AS n_shared FROM b LEFT JOIN a ON a.k = b.k AND a.host = b.host GROUP BY 1""")
def j25_compare_sources(t):
    x = t.pages.withColumn("k", F.col("page_id") % 10)
    live = x.withColumn("url", F.concat(F.lit("https://archive.example/web/20240101000000/"), "url"))
    return ma.compare_sources(live.where("page_id % 3 <> 0"), x.where("page_id % 4 <> 1"), ["k"])


_WORDS = "list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'its', 'their', 'for', 'with', 'that'))"
_CARDS = f"""w AS MATERIALIZED (SELECT doc_id, doc_id // 40 AS document_id, {_WORDS} AS ws FROM documents), x AS MATERIALIZED (SELECT a.document_id, a.doc_id AS ref_id, b.doc_id AS live_id, len(list_intersect(a.ws, b.ws)) / greatest(1, least(len(a.ws), len(b.ws))) AS overlap
 FROM w a JOIN w b ON a.document_id = b.document_id AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1)"""


def _cards(t):
    """Whole texts as cards, forty neighbours together: even ids are references, odd ones live."""
    w = t.documents.select(F.floor(F.col("doc_id") / 40).alias("document_id"), F.col("doc_id").alias("id"), tx.content_words(F.col("text")).alias("words"))
    return w.where("id % 2 = 1"), w.where("id % 2 = 0")


@query(f"WITH {_CARDS} SELECT document_id, ref_id, live_id, round(overlap, 6) AS overlap FROM x WHERE overlap >= 0.25")
def j26_word_pairs(t):
    return ma.word_pairs(*_cards(t)).withColumn("overlap", _r("overlap"))


@query(f"""WITH RECURSIVE {_CARDS}, p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ref_id, overlap DESC, live_id) AS k FROM x WHERE overlap >= 0.25),
s AS (SELECT document_id, 0::BIGINT AS k, []::BIGINT[] AS l, []::BIGINT[] AS r, false AS took FROM (SELECT DISTINCT document_id FROM p)
 UNION ALL SELECT s.document_id, p.k, CASE WHEN free THEN list_append(s.l, p.live_id) ELSE s.l END, CASE WHEN free THEN list_append(s.r, p.ref_id) ELSE s.r END, free
 FROM s JOIN p ON p.document_id = s.document_id AND p.k = s.k + 1, LATERAL (SELECT NOT list_contains(s.l, p.live_id) AND NOT list_contains(s.r, p.ref_id) AS free))
SELECT p.document_id, p.ref_id, p.live_id, round(p.overlap, 6) AS overlap FROM s JOIN p ON p.document_id = s.document_id AND p.k = s.k WHERE s.took""")
def j26_pair_by_words(t):
    """One to one: each reference in turn takes the free live card that shares most words."""
    return ma.pair_by_words(*_cards(t)).withColumn("overlap", _r("overlap"))


@query("""WITH l AS (SELECT document_id, claim_id AS id FROM v_claims), m AS (SELECT document_id, claim_id AS id, claim_id + 1 AS ref_id FROM v_claims WHERE claim_id <= 2), t AS (SELECT document_id, max(claim_id) AS top FROM v_claims GROUP BY 1)
SELECT l.document_id, l.id, CAST(coalesce(m.ref_id, t.top + row_number() OVER (PARTITION BY l.document_id, m.ref_id IS NULL ORDER BY l.id)) AS BIGINT) AS new_id FROM l LEFT JOIN m ON m.document_id = l.document_id AND m.id = l.id JOIN t ON t.document_id = l.document_id""")
def j27_align_ids(t):
    live = t.v_claims.select("document_id", F.col("claim_id").alias("id"))
    m = t.v_claims.where("claim_id <= 2").select("document_id", F.col("claim_id").alias("live_id"), (F.col("claim_id") + 1).alias("ref_id"))
    return ma.align_ids(live, m, ["document_id"], live).withColumn("new_id", F.col("new_id").cast("long"))


@query("""WITH a AS (SELECT document_id, claim_id, type, prominence FROM v_claims WHERE claim_id <> 4), b AS (SELECT document_id, claim_id, type, CASE WHEN claim_id = 2 THEN 0.1e0 ELSE prominence END AS prominence FROM v_claims WHERE claim_id <> 6)
SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.claim_id, b.claim_id) AS claim_id, CASE WHEN b.claim_id IS NULL THEN 'only_left' WHEN a.claim_id IS NULL THEN 'only_right' ELSE 'different' END AS side
FROM a FULL JOIN b ON a.document_id = b.document_id AND a.claim_id = b.claim_id WHERE a.claim_id IS NULL OR b.claim_id IS NULL OR a.prominence <> b.prominence""")
def u4_q22_round_trip_diff(t):
    cols = [*_KEY, "type", "prominence"]
    b = t.v_claims.where("claim_id <> 6").withColumn("prominence", F.when(F.col("claim_id") == 2, 0.1).otherwise(F.col("prominence")))
    return ma.round_trip_diff(t.v_claims.where("claim_id <> 4").select(cols), b.select(cols), _KEY)


@query("""SELECT document_id, claim_id, 'missed' AS side FROM v_claims WHERE claim_id > 3 UNION ALL SELECT document_id, claim_id, 'extra' FROM v_claims WHERE claim_id > 3 AND claim_id <> 6""")
def u3_missed_extra(t):
    m = t.v_claims.where("claim_id <= 3").select(F.col("document_id").alias("ref_document_id"), F.col("claim_id").alias("ref_claim_id"), F.col("document_id").alias("live_document_id"), F.col("claim_id").alias("live_claim_id"))
    return ma.missed_extra(t.v_claims.where("claim_id <> 6"), t.v_claims, m, _KEY)


@query("""WITH e AS (SELECT document_id, evidence_id, min(claim_id) AS c, min(tier) AS tier FROM v_links GROUP BY 1, 2) SELECT document_id, evidence_id FROM e WHERE NOT (tier >= 4)""")
def j22_new_evidence(t):
    e = t.v_links.groupBy("document_id", "evidence_id").agg(F.min("tier").alias("tier")).select("document_id", "evidence_id", "tier", F.concat(F.lit("http://x.example/"), "evidence_id", F.lit("/")).alias("url"), F.concat(F.lit("Quote  "), "evidence_id").alias("quote"))
    prior = e.where("tier >= 4").withColumn("url", F.upper(F.regexp_replace("url", "/$", ""))).withColumn("quote", F.lower(F.regexp_replace("quote", " +", " ")))
    return ma.new_evidence(e, prior).select("document_id", "evidence_id")


@query("SELECT page_id AS evidence_id, CASE WHEN page_id % 5 = 0 THEN 'unreadable' WHEN page_id % 3 = 0 THEN 'absent' ELSE 'verified' END AS outcome FROM pages")
def j8_verify_quotes(t):
    p = t.pages.select("page_id", F.concat("url", F.lit("?"), F.col("page_id").cast("string")).alias("url"), tx.visible_text(F.col("html")).alias("text"))
    quote = F.when(F.col("page_id") % 3 == 0, "words that are not there").otherwise(F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 30))
    ev = p.select(F.col("page_id").alias("evidence_id"), F.concat("url", F.lit("/")).alias("url"), quote.alias("quote"))
    return ma.verify_quotes(ev, p.where("page_id % 5 <> 0")).select("evidence_id", "outcome")


@query("""WITH e AS (SELECT document_id % 100 AS k, evidence_id, tier, CASE WHEN tier = 1 THEN 'unreadable' WHEN tier = 2 THEN 'absent' ELSE 'verified' END AS outcome, tier = 5 AND relation = 'supports' AS downgraded FROM v_links)
SELECT k, count(*) AS n, count(DISTINCT evidence_id) AS sources, count(*) FILTER (WHERE outcome = 'verified') AS verified, count(*) FILTER (WHERE outcome = 'absent') AS absent, count(*) FILTER (WHERE outcome = 'unreadable') AS unreadable, count(*) FILTER (WHERE downgraded) AS downgraded, count(*) - count(DISTINCT (evidence_id, outcome)) AS duplicates FROM e GROUP BY 1""")
def a28_integrity_report(t):
    out = F.when(F.col("tier") == 1, "unreadable").when(F.col("tier") == 2, "absent").otherwise("verified")
    e = ve.downgrade_self_support(t.v_links).select((F.col("document_id") % 100).alias("k"), F.col("evidence_id").alias("url"), out.alias("outcome"), out.alias("quote"), "downgraded")
    return ma.integrity_report(e, ["k"])


# -- knowledge -----------------------------------------------------------------------------------

_TERMS = [("moving", "the"), ("moving", "of the"), ("naming", "ciónes"), ("naming", "and"), ("rare", "zzz"), ("rare", "oil"), ("phrase", "is the"), ("phrase", "el de la")]


def _terms(t):
    return t.documents.sparkSession.createDataFrame(_TERMS, "topic string, term string")


_TERM_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TERMS) + ") v(topic, term)"
_MENTION = f"SELECT DISTINCT doc_id, term FROM documents, (SELECT DISTINCT term FROM {_TERM_SQL}) v WHERE regexp_matches(' ' || lower(text) || ' ', '[^a-z0-9]' || replace(lower(term), ' ', '\\s+') || '[^a-z0-9]')"


@query(_MENTION)
def j16_mentions(t):
    return kn.mentions(t.documents, _terms(t).select("term"))


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM documents)
SELECT doc_id, count(*) AS n_words FROM d WHERE w IN (SELECT w FROM w) GROUP BY 1""")
def j16_benchmark_words(t):
    """All words of the benchmark as terms: a list that grows with its table costs a text no more."""
    words = t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("term")).distinct()
    return kn.mentions(t.documents, words).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"))


@query(f"""WITH m AS ({_MENTION}) SELECT d.doc_id, v.topic, coalesce(string_agg(m.term, ',' ORDER BY m.term), '') AS seen, count(m.term) = 0 AS absent FROM documents d CROSS JOIN {_TERM_SQL} LEFT JOIN m ON m.doc_id = d.doc_id AND m.term = v.term GROUP BY 1, 2""")
def j17_topic_coverage(t):
    return kn.topic_coverage(t.documents, _terms(t)).withColumn("seen", F.coalesce(F.concat_ws(",", "seen"), F.lit("")))


@query("SELECT p.page_id, r.ruling_id FROM pages p, (SELECT DISTINCT ruling_id FROM v_rulings) r WHERE NOT EXISTS (SELECT 1 FROM v_rulings v WHERE v.ruling_id = r.ruling_id AND lower(regexp_replace(v.adjudicated_url, '/+$', '')) = lower(regexp_replace(p.url, '/+$', '')))")
def j14_hold_out(t):
    """Every page with every ruling but those on the page itself."""
    return kn.allowed_rulings(t.pages, t.v_rulings, "page_id")


@query("SELECT DISTINCT p.page_id, v.ruling_id FROM v_rulings v JOIN pages p ON lower(regexp_replace(v.adjudicated_url, '/+$', '')) = lower(regexp_replace(p.url, '/+$', ''))")
def j14_excluded(t):
    return kn.excluded_rulings(t.pages, t.v_rulings, "page_id")


@query("""WITH d AS (SELECT c_custkey AS k, 'I' || (c_custkey % 12) AS code FROM customer) SELECT k, 'E' || (CASE WHEN substr(code, 2)::INT < 6 THEN substr(code, 2)::INT ELSE substr(code, 2)::INT - 6 END) AS entry_id, CASE WHEN substr(code, 2)::INT < 6 THEN 1 ELSE 2 END AS tier FROM d WHERE substr(code, 2)::INT < 9
UNION ALL SELECT k, 'ALL', 3 FROM d""")
def j18_place_by_code(t):
    s = t.customer.sparkSession
    e = s.createDataFrame([(f"E{i}", f"I{i}", [f"I{i + 6}"] if i < 3 else []) for i in range(6)] + [("ALL", "*", [])], "entry_id string, code string, also_codes array<string>")
    return kn.place_by_code(t.customer.select(F.col("c_custkey").alias("k"), F.concat(F.lit("I"), (F.col("c_custkey") % 12).cast("string")).alias("code")), e, "k")


@query("SELECT c_custkey AS k, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cars' WHEN 'MACHINERY' THEN 'tools' WHEN 'BUILDING' THEN 'homes' END AS entry_id FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'BUILDING')")
def j19_place_by_label(t):
    a = t.customer.sparkSession.createDataFrame([("cars", "Auto"), ("cars", "automobile & parts"), ("tools", "machinery"), ("homes", "building"), ("homes", "build")], "entry_id string, alias string")
    return kn.place_by_label(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label")), a, "k").select("k", "entry_id")


@query(f"""WITH m AS ({_MENTION}), s AS (SELECT topic AS entry_id, term FROM {_TERM_SQL}), c AS (SELECT doc_id, lang FROM documents) SELECT c.doc_id AS claim_id, s.entry_id, bool_or(c.lang = 'fr') AS same_company FROM m JOIN s ON s.term = m.term JOIN c ON c.doc_id = m.doc_id
WHERE s.entry_id <> 'naming' OR c.lang = 'es' GROUP BY 1, 2""")
def j20_match_knowledge(t):
    store = _terms(t).select(F.col("topic").alias("entry_id"), "term", F.when(F.col("topic") == "naming", F.array(F.lit("es"))).otherwise(F.array().cast("array<string>")).alias("applies_to"), F.lit("FR!").alias("company"))
    claims = t.documents.select(F.col("doc_id").alias("claim_id"), "text", F.col("lang").alias("type"), F.col("lang").alias("company"))
    return kn.match_knowledge(claims, store)


@query("SELECT source AS store, count(*) AS entries, count(*) FILTER (WHERE doc_id % 3 = 0) AS verified, count(*) FILTER (WHERE doc_id % 4 = 0) AS name_only FROM documents GROUP BY 1")
def a34_store_inventory(t):
    return kn.store_inventory(t.documents.select(F.col("source").alias("store"), (F.col("doc_id") % 3 == 0).alias("verified"), F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("quote")))


@query("""SELECT * FROM (SELECT page_id || CASE WHEN page_id % 7 = 0 THEN '!' ELSE '' END AS entry_id, unnest(list_filter([CASE WHEN page_id % 7 = 0 THEN 'id' END, CASE WHEN page_id % 5 = 0 THEN 'date' END, CASE WHEN page_id % 4 = 0 THEN 'url' END, CASE WHEN page_id % 2 = 0 AND page_id % 3 = 0 THEN 'verified_without_quote' END, CASE WHEN page_id % 2 = 0 AND page_id % 9 = 0 THEN 'verified_without_method' END], lambda x: x IS NOT NULL)) AS rule FROM pages)""")
def q20_store_violations(t):
    p = F.col("page_id")
    s = t.pages.select(F.concat(p.cast("string"), F.when(p % 7 == 0, "!").otherwise("")).alias("entry_id"), F.when(p % 5 == 0, "2024-13-45").otherwise("2024-01-31").alias("date"), F.when(p % 4 == 0, F.concat(F.lit("x:"), "url")).otherwise(F.col("url")).alias("url"),
                       (p % 2 == 0).alias("verified"), F.when(p % 3 != 0, "words").alias("quote"), F.when(p % 9 == 0, "unverified").otherwise("fetched_exact").alias("method"))
    return kn.store_violations(s)


@query("SELECT code, count(*) AS n FROM (SELECT page_id, 'I' || (page_id % 120) AS code FROM pages UNION SELECT page_id, 'I' || (page_id * 7 % 130) FROM pages) GROUP BY 1 HAVING count(*) > 1")
def q21_code_violations(t):
    p = F.col("page_id")
    code = lambda x: F.concat(F.lit("I"), x.cast("string"))
    return kn.code_violations(t.pages.select(p.alias("entry_id"), code(p % 120).alias("code"), F.array(code(p * 7 % 130)).alias("also_codes")))


@query("""WITH n AS (SELECT s_name, lower(replace(s_name, '#', '-')) AS slug FROM supplier), q AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN lower(replace(s_name, '#', '-')) WHEN s_suppkey % 3 = 1 THEN left(lower(replace(s_name, '#', '-')), 15) ELSE 'nobody' END AS w FROM supplier)
SELECT 'q' || s_suppkey AS query, coalesce((SELECT min(s_name) FROM n WHERE n.slug = q.w), (SELECT CASE WHEN count(*) = 1 THEN min(s_name) END FROM n WHERE starts_with(n.slug, q.w))) AS name FROM q""")
def j28_resolve_company(t):
    from ..operators.company import resolve_company

    sl = F.lower(F.replace(F.col("s_name"), F.lit("#"), F.lit("-")))
    k = F.col("s_suppkey")
    q = t.supplier.select(F.concat(F.lit("q"), k.cast("string")).alias("query"), F.when(k % 3 == 0, sl).when(k % 3 == 1, F.substring(sl, 1, 15)).otherwise("nobody").alias("slug"))
    return resolve_company(q, t.supplier.select(F.col("s_name").alias("name"), sl.alias("slug")))


# -- blocks ----------------------------------------------------------------------------------------


def _blocks(t):
    """Lines as blocks: the first is the title, some are headings, list items, captions or quotes by their number."""
    b = sp.line_regions(t.documents).where("text <> ''")
    n = F.col("line_no")
    kind = F.when(n == 0, "title").when(n % 6 == 2, "heading").when(n % 6 == 4, "list_item").when(n % 11 == 5, "caption").when(n % 13 == 7, "quote").otherwise("paragraph")
    return b.select("document_id", n.alias("block_no"), kind.alias("kind"), F.when(kind == "heading", 1 + (n % 3)).cast("int").alias("level"), "text")


_BL = """SELECT document_id, line_no AS block_no, CASE WHEN line_no = 0 THEN 'title' WHEN line_no % 6 = 2 THEN 'heading' WHEN line_no % 6 = 4 THEN 'list_item' WHEN line_no % 11 = 5 THEN 'caption' WHEN line_no % 13 = 7 THEN 'quote' ELSE 'paragraph' END AS kind, CASE WHEN line_no > 0 AND line_no % 6 = 2 THEN 1 + line_no % 3 END AS level, line AS text FROM (""" + _REGIONS + ") WHERE line <> ''"
_WC = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query(f"SELECT document_id, block_no, CASE WHEN kind = 'heading' AND {_WC} > 15 THEN 'paragraph' ELSE kind END AS kind FROM ({_BL})")
def p23_demote_headings(t):
    return bl.demote_headings(_blocks(t)).select("document_id", "block_no", "kind")


@query(f"""WITH b AS (SELECT *, CASE WHEN kind = 'quote' THEN 'quote' WHEN block_no % 5 = 1 THEN 'promo' WHEN block_no % 7 = 6 THEN 'footnote' END AS container FROM ({_BL})),
x AS (SELECT *, max((kind = 'title')::INT) OVER (PARTITION BY document_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS t FROM b), y AS (SELECT *, kind = 'paragraph' AND container IS NULL AND coalesce(t, 0) = 1 AS c FROM x)
SELECT document_id, block_no, CASE WHEN kind IN ('title', 'heading') THEN NULL WHEN container = 'quote' THEN 0.7 WHEN container = 'promo' THEN 0.5 WHEN container = 'footnote' THEN 0.3
 WHEN c AND sum(c::INT) OVER (PARTITION BY document_id ORDER BY block_no) = 1 THEN 1.0 WHEN kind = 'caption' THEN 0.4 ELSE 0.6 END AS prominence FROM y""")
def w13_assign_prominence(t):
    n = F.col("block_no")
    held = F.when(F.col("kind") == "quote", "quote").when(n % 5 == 1, "promo").when(n % 7 == 6, "footnote")
    return bl.assign_prominence(_blocks(t).withColumn("container", held)).select("document_id", "block_no", "prominence")


_ENDS = f"WITH b AS ({_BL}), h AS (SELECT *, CASE WHEN kind = 'title' THEN 0 ELSE level END AS l FROM b WHERE kind IN ('title', 'heading')), e AS (SELECT x.document_id, x.block_no, x.text, min(y.block_no) AS e FROM h x LEFT JOIN h y ON y.document_id = x.document_id AND y.block_no > x.block_no AND y.l <= x.l WHERE x.kind = 'heading' GROUP BY 1, 2, 3)"


@query(_ENDS + " SELECT b.document_id, b.block_no FROM b LEFT JOIN e ON e.document_id = b.document_id AND e.block_no = b.block_no WHERE b.kind <> 'heading' OR EXISTS (SELECT 1 FROM b c WHERE c.document_id = b.document_id AND c.block_no > b.block_no AND c.kind NOT IN ('heading', 'title') AND (e.e IS NULL OR c.block_no < e.e))")
def w14_drop_empty_headings(t):
    return bl.drop_empty_headings(_blocks(t)).select("document_id", "block_no")


@query(_ENDS + " SELECT b.document_id, b.block_no, arg_max(CASE WHEN e.block_no % 12 = 2 THEN 'footnote' ELSE 'cautionary' END, e.block_no) AS container FROM b JOIN e ON e.document_id = b.document_id AND e.block_no <= b.block_no AND (e.e IS NULL OR b.block_no < e.e) GROUP BY 1, 2")
def w15_section_containers(t):
    named = _blocks(t).withColumn("text", F.when((F.col("kind") == "heading") & (F.col("block_no") % 12 == 2), "Notes").when(F.col("kind") == "heading", "Disclaimer").otherwise(F.col("text")))
    return bl.section_containers(named).where("container is not null").select("document_id", "block_no", "container")


@query(f"""WITH b AS ({_BL}), x AS (SELECT *, lag(kind) OVER w AS pk, lag(text) OVER w AS pt FROM b WINDOW w AS (PARTITION BY document_id ORDER BY block_no)), y AS (SELECT *, kind IN ('paragraph', 'list_item') AND NOT coalesce(kind = 'list_item' AND (pk = 'list_item' OR (pk = 'paragraph' AND suffix(pt, ':'))), false) AS f FROM x)
SELECT document_id, block_no, CASE WHEN kind IN ('paragraph', 'list_item') THEN 'P' || CAST(sum(f::INT) OVER (PARTITION BY document_id ORDER BY block_no) AS BIGINT) END AS label FROM y""")
def w16_group_paragraphs(t):
    return bl.group_paragraphs(_blocks(t)).select("document_id", "block_no", "label")


@query(f"SELECT document_id, block_no, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({_BL})")
def w17_assemble_text(t):
    texts, regions = bl.assemble_text(_blocks(t))
    ok = regions.join(texts.select("document_id", F.col("text").alias("whole")), "document_id").where(F.substr("whole", F.col("start").cast("int") + 1, F.length("text")) == F.col("text"))
    return ok.select("document_id", "block_no", "start")


@query(f"SELECT document_id, block_no, CASE WHEN n > 1 THEN k || ' (' || n || ')' ELSE k END AS \"unique\" FROM (SELECT *, left(text, 4) AS k, row_number() OVER (PARTITION BY document_id, left(text, 4) ORDER BY block_no) AS n FROM ({_BL}))")
def w18_unique_labels(t):
    return bl.unique_labels(_blocks(t).withColumn("k", F.substring("text", 1, 4)), "k").select("document_id", "block_no", "unique")


@query(f"""WITH b AS ({_BL}), x AS (SELECT *, kind = 'paragraph' AND {_WC} <= 8 AS s, max(CASE WHEN kind = 'quote' THEN block_no END) OVER (PARTITION BY document_id ORDER BY block_no) AS q FROM b)
SELECT document_id, block_no, CASE WHEN s AND q IS NOT NULL AND block_no - q <= 3 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.document_id = x.document_id AND y.block_no > x.q AND y.block_no <= x.block_no AND NOT y.s) THEN 'caption' ELSE kind END AS kind FROM x""")
def w19_quote_attribution(t):
    return bl.quote_attribution(_blocks(t)).select("document_id", "block_no", "kind")


@query(f"""WITH b AS ({_BL}), w AS (SELECT document_id, kind, sum({_WC} * CASE WHEN kind = 'caption' THEN 0.4e0 ELSE 0.6e0 END) AS w FROM b GROUP BY 1, 2) SELECT document_id, kind, round(w / nullif(sum(w) OVER (PARTITION BY document_id), 0), 6) AS share FROM w""")
def a35_attention_share(t):
    b = _blocks(t).withColumn("prominence", F.when(F.col("kind") == "caption", 0.4).otherwise(0.6))
    return bl.attention_share(b).select("document_id", "kind", _r("share"))


@query(f"SELECT document_id, kind, count(*) AS n FROM ({_BL}) GROUP BY 1, 2")
def a30_region_counts(t):
    return bl.region_counts(_blocks(t))


@query(f"""SELECT document_id, string_agg(CASE WHEN kind = 'title' THEN '# ' WHEN kind = 'heading' THEN repeat('#', CAST(level + 1 AS BIGINT)) || ' ' WHEN kind = 'list_item' THEN '- ' ELSE '' END || text, chr(10) ORDER BY block_no) AS text FROM ({_BL}) GROUP BY 1""")
def s9_to_marked_text(t):
    return bl.to_marked_text(_blocks(t))


@query(f"""SELECT l.document_id, l.line_no, b.kind FROM ({_REGIONS}) l LEFT JOIN ({_BL}) b ON b.document_id = l.document_id AND b.block_no = l.line_no WHERE l.len > 0""")
def w21_layout_lines(t):
    lines = sp.line_regions(t.documents).drop("text")
    r = _blocks(t).join(lines.withColumnRenamed("line_no", "block_no"), ["document_id", "block_no"])
    return bl.layout_lines(lines, r).select("document_id", "line_no", "kind")


# -- orders and sets -----------------------------------------------------------------------------


@query("""SELECT document_id, claim_id, evidence_id, CAST(row_number() OVER (PARTITION BY document_id, claim_id ORDER BY CASE relation WHEN 'contradicts' THEN 0 WHEN 'contradicts_framing' THEN 1 WHEN 'supports' THEN 2 WHEN 'criteria' THEN 3 WHEN 'precedent' THEN 4 ELSE 5 END, tier, evidence_id, relation) AS INT) AS rank FROM v_links""")
def t3_order_evidence(t):
    from ..config import RELATIONS

    place = F.create_map(*[F.lit(x) for kv in zip(RELATIONS, range(6)) for x in kv])[F.col("relation")]
    return od.top_k(t.v_links.withColumn("p", place), _KEY, [F.col("p"), F.col("tier"), F.col("evidence_id"), F.col("relation")]).select(*_KEY, "evidence_id", "rank")


@query("SELECT document_id, CAST(row_number() OVER (ORDER BY score DESC, confidence DESC, document_id) AS BIGINT) AS place FROM v_omissions")
def t5_omission_order(t):
    return od.numbered(t.v_omissions, [F.desc("score"), F.desc("confidence"), F.asc("document_id")]).select("document_id", "place")


@query("SELECT document_id, claim_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY CASE WHEN claim_id % 3 = 0 THEN NULL ELSE prominence END ASC NULLS LAST, claim_id) AS INT) AS rank FROM v_claims")
def t6_claims_by_span(t):
    at = F.when(F.col("claim_id") % 3 != 0, F.col("prominence"))
    return od.top_k(t.v_claims.withColumn("at", at), ["document_id"], [F.asc_nulls_last("at"), F.col("claim_id")]).select(*_KEY, "rank")


@query("SELECT l_orderkey AS document_id, l_linenumber AS mark_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey DESC, l_linenumber, l_extendedprice) AS INT) AS rank FROM lineitem")
def t8_marks(t):
    x = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("mark_id"), "l_suppkey", "l_partkey", "l_extendedprice")
    return od.top_k(x, ["document_id"], [F.col("l_suppkey"), F.desc("l_partkey"), F.col("mark_id"), F.col("l_extendedprice")]).select("document_id", "mark_id", "rank")


@query("SELECT company_id, document_id, CAST(row_number() OVER (PARTITION BY company_id ORDER BY doc_date ASC NULLS FIRST, document_id) AS INT) AS rank FROM v_documents")
def t10_documents_oldest_first(t):
    return od.top_k(t.v_documents, ["company_id"], [F.asc_nulls_first("doc_date"), F.col("document_id")]).select("company_id", "document_id", "rank")


@query("SELECT document_id, claim_id, count(DISTINCT evidence_id) AS n FROM (SELECT document_id, claim_id, evidence_id FROM v_links WHERE tier <= 2 UNION ALL SELECT document_id, claim_id, evidence_id FROM v_links WHERE relation = 'supports' UNION ALL SELECT document_id, claim_id, evidence_id FROM v_links WHERE tier = 4) GROUP BY 1, 2")
def u2_u7_cited_ids(t):
    cols = [*_KEY, "evidence_id"]
    parts = [t.v_links.where(c).select(cols) for c in ("tier <= 2", "relation = 'supports'", "tier = 4")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct().groupBy(_KEY).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT document_id, string_agg(relation, ',' ORDER BY f) AS relations FROM (SELECT document_id, relation, min((claim_id, evidence_id)) AS f FROM v_links GROUP BY 1, 2) GROUP BY 1")
def u5_ordered_distinct(t):
    first = t.v_links.groupBy("document_id", "relation").agg(F.min(F.struct("claim_id", "evidence_id")).alias("f"))
    return first.groupBy("document_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("f", "relation"))), lambda x: x["relation"])).alias("relations"))


@query("SELECT document_id, CASE min(CASE relation WHEN 'contradicts' THEN 0 WHEN 'supports' THEN 1 ELSE 2 END) WHEN 0 THEN 'flag' WHEN 1 THEN 'credit' ELSE 'benign' END AS polarity FROM v_links GROUP BY 1")
def a31_strongest_polarity(t):
    pol = F.when(F.col("relation") == "contradicts", "flag").when(F.col("relation") == "supports", "credit").otherwise("benign")
    rank = F.when(F.col("p") == "flag", 0).when(F.col("p") == "credit", 1).otherwise(2)
    return t.v_links.withColumn("p", pol).groupBy("document_id").agg(F.min_by("p", rank).alias("polarity"))


@query("""WITH c AS (SELECT document_id, claim_id, evidence_id FROM v_links WHERE tier <= 2), l AS (SELECT document_id, claim_id, evidence_id, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations FROM v_links WHERE tier >= 2 GROUP BY 1, 2, 3)
SELECT * FROM l UNION ALL SELECT DISTINCT document_id, claim_id, evidence_id, 'cited' FROM c WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.document_id = c.document_id AND l.claim_id = c.claim_id AND l.evidence_id = c.evidence_id)""")
def j3_claim_evidence(t):
    l = ve.evidence_for(t.v_claims, t.v_links.where("tier >= 2")).select(*_KEY, "evidence_id", F.concat_ws(",", "relations").alias("relations"))
    c = t.v_links.where("tier <= 2").select(*_KEY, "evidence_id").distinct().join(l, [*_KEY, "evidence_id"], "left_anti")
    return l.unionByName(c.withColumn("relations", F.lit("cited")))


@query("""WITH r AS (SELECT o_orderkey AS document_id, o_custkey AS k, o_totalprice AS v FROM orders) SELECT k, arg_max(document_id, (v, document_id)) AS document_id, count(*) - 1 AS duplicates FROM r GROUP BY 1""")
def w12_collapse_best(t):
    from ..operators.company import collapse_best

    r = t.orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.lit(0).alias("duplicates"))
    return collapse_best(r, F.col("k"), [F.desc("v"), F.desc("document_id")]).select("k", "document_id", "duplicates")


_URL = "lower(regexp_replace(trim(url), '/+$', ''))"


@query(f"""WITH a AS (SELECT {_URL} AS u, min(page_id) AS order_key, arg_min('t' || page_id % 5, page_id) AS title, arg_min('c' || page_id % 4, page_id) AS company FROM pages WHERE page_id % 3 <> 0 GROUP BY 1),
b AS (SELECT {_URL} AS u, max(page_id) AS analysis_id, arg_max('x' || page_id % 6, page_id) AS title, arg_max('y' || page_id % 7, page_id) AS company FROM pages WHERE page_id % 4 <> 0 GROUP BY 1),
x AS (SELECT coalesce(a.u, b.u) AS url, coalesce(a.title, b.title) AS title, coalesce(a.company, b.company) AS company, a.u IS NOT NULL AS curated, b.u IS NOT NULL AS recorded, a.order_key, b.analysis_id FROM a FULL JOIN b ON a.u = b.u)
SELECT url, title, company, curated, recorded, coalesce(analysis_id, -1) AS analysis_id, row_number() OVER (ORDER BY recorded DESC, curated DESC, order_key NULLS LAST, company, title, url) AS place FROM x""")
def s6_t4_document_catalogue(t):
    """All fields and the place of every document, curated ones, recorded ones and both."""
    from ..operators.ordering import numbered
    from ..sources.logs import catalogue_order, document_catalogue

    i = F.col("page_id")
    name = lambda c, m: F.concat(F.lit(c), (i % m).cast("string"))
    docs = t.pages.where("page_id % 3 <> 0").select(F.concat("url", F.lit("/")).alias("url"), name("t", 5).alias("title"), name("c", 4).alias("company"), i.alias("order_key"))
    logs = t.pages.where("page_id % 4 <> 0").select("url", i.alias("analysis_id"), name("x", 6).alias("title"), name("y", 7).alias("company"))
    out = numbered(document_catalogue(docs, logs), catalogue_order())
    return out.select("url", "title", "company", "curated", "recorded", F.coalesce("analysis_id", F.lit(-1)).alias("analysis_id"), "place")
