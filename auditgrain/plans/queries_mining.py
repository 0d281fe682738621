"""Queries of the mining operators, with words of the invented prose as lexicons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import STOP_WORDS
from ..operators import mining as mi
from ..operators.spans import line_regions
from .queries_match import _MENTION, _TERM_SQL, _terms
from .registry import query

CLAIM_WORDS = {"commitment": ["with", "que"], "certification": ["was"], "comparative": ["une", "sch"], "factual": ["the"]}
MARKS = {"hedge": ["the", "der"], "vague_term": ["and", "und"], "intensifier": ["that"]}

_S = r"""SELECT doc_id AS document_id, trim(s) AS text, line_no, p FROM (SELECT doc_id, line_no, generate_subscripts(ss, 1) AS p, unnest(ss) AS s FROM (SELECT doc_id, line_no, string_split(regexp_replace(line, '([.!?]) ', '\1' || chr(1) || ' ', 'g'), chr(1)) AS ss
 FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents))) WHERE trim(s) <> ''"""


def _rx(words):
    return r"(?i)(^|[^\pL\d])(" + "|".join(words) + r")([^\pL\d]|$)"


_C = "SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY line_no, p) AS claim_id FROM (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(text, '{_rx(w)}') THEN '{k}'" for k, w in CLAIM_WORDS.items()) + f" END AS type FROM ({_S})) WHERE type IS NOT NULL"


@query(f"SELECT document_id, claim_id, type, text FROM ({_C})")
def m1_mine_claims(t):
    return mi.mine_claims(t.documents, CLAIM_WORDS).select("document_id", "claim_id", "type", "text")


@query(f"SELECT document_id, claim_id, nullif(regexp_extract(text, '(?i){mi.QUANTITY}', 1), '') AS quantity, nullif(regexp_extract(text, '(?i){mi.YEAR}', 1), '') AS timeframe FROM ({_C})")
def m2_extract_quantities(t):
    return mi.extract_quantities(mi.mine_claims(t.documents, CLAIM_WORDS)).select("document_id", "claim_id", "quantity", "timeframe")


_LINES = "SELECT doc_id AS document_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"
_BOILERPLATE = f"SELECT document_id, line_no FROM ({_LINES}) WHERE line IN (SELECT line FROM ({_LINES}) WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT document_id) > 2)"


def _typed(lexicon):
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{_rx(w)}') THEN '{k}'" for k, w in lexicon.items()) + " END"


@query(f"""SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY line_no, p) AS claim_id, type, text FROM (SELECT *, {_typed(mi.CLAIM_LEXICON)} AS type FROM ({_S}))
WHERE type IS NOT NULL AND (document_id, line_no) NOT IN ({_BOILERPLATE})""")
def m1_claims_outside_regions(t):
    """The English lexicon; lines that stand in more than two documents are boilerplate, a cautionary region."""
    lines = line_regions(t.documents)
    often = lines.where(F.trim("text") != "").groupBy("text").agg(F.count_distinct("document_id").alias("n")).where("n > 2").select("text")
    shut = lines.join(often, "text", "left_semi").select("document_id", F.lit("cautionary").alias("kind"), "start", "end")
    return mi.mine_claims(t.documents, regions=shut).select("document_id", "claim_id", "type", "text")


_PLACES = r"""SELECT doc_id AS document_id, line_no, p, trim(s) AS text, CAST(lstart + coalesce(list_sum([length(x) FOR x IN ss[1:p - 1]]), 0) + length(s) - length(ltrim(s)) AS BIGINT) AS start FROM (
 SELECT doc_id, line_no, lstart, ss, generate_subscripts(ss, 1) AS p, unnest(ss) AS s FROM (SELECT *, string_split(regexp_replace(line, '([.!?]) ', '\1' || chr(1) || ' ', 'g'), chr(1)) AS ss FROM (
 SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lstart
 FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)))) WHERE trim(s) <> ''"""


def _marks_sql(lexicon):
    rows = ", ".join(f"('{k}', '{w}')" for k, ws in lexicon.items() for w in ws)
    return f"""WITH c AS ({_C}), pl AS ({_PLACES}), q AS (SELECT c.document_id, c.claim_id, lower(c.text) AS t, pl.start AS c0 FROM c JOIN pl ON pl.document_id = c.document_id AND pl.line_no = c.line_no AND pl.p = c.p),
h AS (SELECT document_id, claim_id, kind, term, t, c0, unnest(list_filter(range(0, length(t)), lambda i: substr(t, i + 1, length(term)) = term)) AS o FROM q, (VALUES {rows}) v(kind, term) WHERE contains(t, term))
SELECT document_id, claim_id, kind, CAST(c0 + o AS BIGINT) AS start, CAST(c0 + o + length(term) AS BIGINT) AS "end", term FROM h WHERE (o = 0 OR NOT regexp_matches(substr(t, o, 1), '[\\pL\\d]')) AND NOT regexp_matches(substr(t, o + length(term) + 1, 1), '[\\pL\\d]')"""


def _marks(t, lexicon):
    out = mi.mine_signals(mi.mine_claims(t.documents, CLAIM_WORDS), lexicon)
    return out.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))


@query(_marks_sql(MARKS))
def m3_mine_signals(t):
    """Marks with their places."""
    return _marks(t, MARKS)


#: The English lexicon, and words and phrases that the prose has.
ALL_MARKS = mi.MARK_LEXICON | {"quantifier": ["of the", "is", "to the", "la", "que"], "negation": ["not", "it is", "de la"]}


@query(_marks_sql(ALL_MARKS))
def m3_all_marks(t):
    return _marks(t, ALL_MARKS)


@query(f"""WITH t AS (SELECT document_id, claim_id, text || CASE WHEN claim_id % 5 = 1 THEN ' less than in 2019' WHEN claim_id % 5 = 2 THEN ' since 2015' WHEN claim_id % 5 = 3 THEN ' by 40%' ELSE '' END AS text FROM ({_C})),
c AS (SELECT *, regexp_matches(text, '(?i){mi.QUANTITY}') AS num, regexp_matches(text, '(?i){mi.YEAR}') AS year, regexp_matches(text, '(?i){mi.BASELINE}') AS base, regexp_matches(text, '{_rx(MARKS["vague_term"])}') AS vague, regexp_matches(text, '{_rx(sum(MARKS.values(), []))}') AS hit FROM t)
SELECT document_id, claim_id, CASE WHEN NOT hit THEN 'none' WHEN base THEN 'credit' WHEN num OR year THEN 'benign' ELSE 'flag' END AS polarity,
 CASE WHEN vague AND NOT num THEN 0.8 WHEN hit AND NOT base AND NOT num AND NOT year THEN 0.55 WHEN vague THEN 0.4 WHEN num THEN 0.15 ELSE 0.3 END AS score FROM c""")
def m4_m5_score_clarity(t):
    """All claims, some with a baseline, a year or a percentage put behind them: credit, benign marks and flags."""
    k = F.col("claim_id") % 5
    more = F.when(k == 1, " less than in 2019").when(k == 2, " since 2015").when(k == 3, " by 40%").otherwise("")
    c = mi.extract_quantities(mi.mine_claims(t.documents, CLAIM_WORDS).withColumn("text", F.concat("text", more)))
    out = mi.clarity_of_claims(c, MARKS)
    return out.select("document_id", "claim_id", F.coalesce("polarity", F.lit("none")).alias("polarity"), "score")


_NEAR = f"""tw AS (SELECT DISTINCT topic, unnest(regexp_extract_all(lower(term), '[a-z0-9]+')) AS w FROM {_TERM_SQL}), tk AS (SELECT topic, w FROM tw WHERE length(w) > 2 AND w NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)})),
st AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws FROM ({_S})), sh AS (SELECT document_id, topic, line_no, p, text, count(*) AS n FROM st JOIN tk ON list_contains(st.ws, tk.w) GROUP BY ALL),
nr AS (SELECT document_id, topic, arg_max(text, (n, -line_no, -p)) AS nearest FROM sh GROUP BY 1, 2)"""


@query(f"""WITH m AS ({_MENTION}), c AS (SELECT d.doc_id, v.topic, count(*) AS n, count(m.term) AS seen FROM documents d CROSS JOIN {_TERM_SQL} LEFT JOIN m ON m.doc_id = d.doc_id AND m.term = v.term GROUP BY 1, 2), {_NEAR}
SELECT c.doc_id, c.topic, CASE WHEN seen > 0 AND nearest IS NULL THEN 0.56 ELSE 0.7 END AS score, nearest FROM c LEFT JOIN nr ON nr.document_id = c.doc_id AND nr.topic = c.topic WHERE seen * 2 < n""")
def m6_mine_omissions(t):
    return mi.mine_omissions(t.documents, _terms(t)).withColumn("score", F.round("score", 6))


@query(f"""WITH s AS (SELECT DISTINCT document_id, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM ({_S})), o AS (SELECT * FROM s WHERE length(x) % 7 <> 0), n AS (SELECT * FROM s WHERE length(x) % 5 <> 0),
b AS (SELECT coalesce(o.document_id, n.document_id) AS document_id, CASE WHEN o.x IS NULL THEN 'added' WHEN n.x IS NULL THEN 'dropped' ELSE 'kept' END AS side FROM o FULL JOIN n ON o.document_id = n.document_id AND o.x = n.x)
SELECT document_id, side, count(*) AS n FROM b GROUP BY 1, 2""")
def j30_compare_versions(t):
    s = mi.sentences(t.documents)
    size = F.length(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))))
    return mi.compare_versions(s.where(size % 7 != 0), s.where(size % 5 != 0)).drop("share")


_CONTENT = f"list_sort(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: length(w) > 2 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN ({', '.join(f"'{w}'" for w in STOP_WORDS)})))"


@query(f"""WITH s AS (SELECT document_id, text, line_no, p, {_CONTENT} AS ws FROM ({_S})), d AS (SELECT *, row_number() OVER (PARTITION BY document_id, ws ORDER BY line_no, p) AS k FROM s WHERE len(ws) > 2),
u AS (SELECT document_id, text, row_number() OVER (PARTITION BY document_id ORDER BY line_no, p) AS n FROM d WHERE k = 1),
v AS (SELECT document_id, n AS old_no, text || ' by ' || (2030 + n % 5) || ' at ' || (40 + n % 7) || '%' AS old,
 CASE WHEN n % 7 <> 0 THEN CASE WHEN n % 7 = 6 THEN 'Indeed ' ELSE '' END || text || ' by ' || (2030 + n % 5 + CASE WHEN n % 7 = 1 THEN 3 ELSE 0 END) || ' at ' || (40 + n % 7 - CASE WHEN n % 7 = 2 THEN 15 WHEN n % 7 = 3 THEN -15 ELSE 0 END) || '%' END AS new FROM u),
y AS (SELECT *, TRY_CAST(regexp_extract(old, '\\b((?:19|20)\\d{{2}})\\b', 1) AS INT) AS y0, TRY_CAST(regexp_extract(new, '\\b((?:19|20)\\d{{2}})\\b', 1) AS INT) AS y1, TRY_CAST(replace(regexp_extract(old, '(\\d[\\d,]*(?:\\.\\d+)?)\\s?%', 1), ',', '') AS DOUBLE) AS x0, TRY_CAST(replace(regexp_extract(new, '(\\d[\\d,]*(?:\\.\\d+)?)\\s?%', 1), ',', '') AS DOUBLE) AS x1 FROM v)
SELECT document_id, old_no, CASE WHEN new IS NULL THEN 'dropped' WHEN old = new THEN 'unchanged' WHEN y1 > y0 THEN 'delayed' WHEN x1 < x0 THEN 'weakened' WHEN x1 > x0 THEN 'strengthened' ELSE 'restated' END AS change FROM y""")
def m7_version_changes(t):
    """Two versions of every document: sentences with other years and percentages, reworded ones and dropped ones; the operator finds the pairs, SQL knows them."""
    # an array of one is filtered: for a filter of rows Spark would make the words a second time
    worded = F.filter(F.array(F.struct(F.sort_array(mi.letter_words(F.col("text"))).alias("ws"))), lambda x: F.size(x["ws"]) > 2)
    s = mi.sentence_texts(t.documents).select("document_id", "sentence_no", "text", F.inline(worded))
    first = Window.partitionBy("document_id", "ws").orderBy("sentence_no")
    u = s.withColumn("k", F.row_number().over(first)).where("k = 1").drop("ws")
    u = u.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("sentence_no")))
    k = F.col("n") % 7
    whole = lambda head, later, more: F.concat(head, "text", F.lit(" by "), (2030 + F.col("n") % 5 + later).cast("string"), F.lit(" at "), (40 + k + more).cast("string"), F.lit("%"))
    version = lambda side, text: F.struct(F.lit(side).alias("side"), F.col("n").alias("sentence_no"), text.alias("text"))
    old = version(0, whole(F.lit(""), 0, 0))
    new = version(1, whole(F.when(k == 6, "Indeed ").otherwise(""), F.when(k == 1, 3).otherwise(0), F.when(k == 2, -15).when(k == 3, 15).otherwise(0)))
    both = u.select("document_id", F.inline(F.when(k == 0, F.array(old)).otherwise(F.array(old, new))))
    return mi.changes_of(both).where("old_no is not null").select("document_id", F.col("old_no").cast("long").alias("old_no"), "change")


@query(f"""SELECT d.source, count(*) AS n_claims, count(DISTINCT c.document_id) AS n_documents FROM ({_C}) c JOIN documents d ON d.doc_id = c.document_id GROUP BY d.source, lower(regexp_replace(trim(c.text), '\\s+', ' ', 'g')) HAVING count(DISTINCT c.document_id) > 1""")
def m8_restated_claims(t):
    c = mi.mine_claims(t.documents, CLAIM_WORDS).join(t.documents.select(F.col("doc_id").alias("document_id"), "source"), "document_id")
    return mi.restated_claims(c, "source").drop("h")
