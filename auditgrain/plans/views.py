"""Audit tables as views over the given tables, by plain arithmetic; the same text runs on Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "v_claims": """SELECT l_orderkey AS document_id, l_linenumber AS claim_id,
       CASE WHEN l_linenumber = 1 THEN 1e0 WHEN l_linenumber = 7 THEN 3e-1 ELSE 6e-1 END AS prominence,
       CASE MAX(l_partkey) % 5 WHEN 0 THEN 'factual' WHEN 1 THEN 'commitment' WHEN 2 THEN 'comparative'
            WHEN 3 THEN 'vague_attribute' ELSE 'certification' END AS type
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "v_base": """SELECT l_orderkey AS document_id, l_linenumber AS claim_id, MIN(l_discount) AS d, MIN(l_tax) AS t,
       MIN(l_quantity) AS q, MIN(l_suppkey) AS s, MIN(l_partkey) AS p FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "v_scores": """SELECT document_id, claim_id, 'clarity' AS dimension, ROUND(d * 1e1, 2) AS score, ROUND(3e-1 + (s % 8) / 1e1, 2) AS confidence FROM {v_base}
UNION ALL SELECT document_id, claim_id, 'support', ROUND(t * 125e-1, 2), ROUND(3e-1 + (p % 8) / 1e1, 2) FROM {v_base}
UNION ALL SELECT document_id, claim_id, 'materiality', ROUND(q / 5e1, 2), ROUND(3e-1 + claim_id / 1e1, 2) FROM {v_base}
UNION ALL SELECT document_id, claim_id, 'consistency', ROUND((s % 11) / 1e1, 2), ROUND(3e-1 + (s % 5) / 1e1, 2) FROM {v_base} WHERE s % 13 <> 0""",
    "v_links": """SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS claim_id,
       CONCAT('E', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS evidence_id, CAST(1 + l_suppkey % 5 AS INT) AS tier,
       CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'contradicts' WHEN l_returnflag = 'R' THEN 'contradicts_framing'
            WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'supports' WHEN l_returnflag = 'A' THEN 'context'
            WHEN l_linestatus = 'F' THEN 'criteria' ELSE 'precedent' END AS relation
FROM {lineitem} WHERE l_partkey % 3 <> 0""",
    "v_documents": """SELECT o_orderkey AS document_id, o_custkey AS company_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS doc_date FROM {orders}""",
    "v_omissions": """SELECT o_orderkey AS document_id, 'O1' AS omission_id, ROUND((o_custkey % 10) / 1e1, 2) AS score,
       ROUND(4e-1 + (o_orderkey % 6) / 1e1, 2) AS confidence FROM {orders} WHERE o_orderpriority LIKE '1%'""",
    "v_cases": """SELECT l.doc_id AS case_id, CASE WHEN l.doc_id % 17 = 0 THEN NULL ELSE ROUND((d.n_chars % 101) / 1e2, 2) END AS likelihood,
       CASE WHEN l.toxic = 1 THEN NULL ELSE 1 - l.quality END AS label FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    "v_log": """SELECT user_id AS analysis_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts,
       CASE event_type WHEN 'signup' THEN 'stage.started' WHEN 'purchase' THEN 'stage.completed' WHEN 'click' THEN 'claim.extracted'
            WHEN 'view' THEN 'evidence.added' ELSE 'dimension.scored' END AS type,
       CAST(event_id % 20 AS BIGINT) AS entity_id, value, props AS payload FROM {events}""",
    "v_captures": "SELECT user_id AS url_id, ts AS stamp, event_type AS digest FROM {events}",
    "v_rulings": """SELECT b.item_id AS ruling_id, b.text AS claim_text, p.url AS adjudicated_url
FROM {benchmark} b LEFT JOIN {pages} p ON p.page_id = b.item_id""",
    # Derived by the published formulas, for oracles of later operators only.
    "v_wide": """SELECT c.document_id, c.claim_id, c.prominence, c.type,
       MAX(CASE WHEN dimension = 'clarity' THEN score END) AS clarity, MAX(CASE WHEN dimension = 'clarity' THEN confidence END) AS clarity_conf,
       MAX(CASE WHEN dimension = 'support' THEN score END) AS support, MAX(CASE WHEN dimension = 'support' THEN confidence END) AS support_conf,
       MAX(CASE WHEN dimension = 'materiality' THEN score END) AS materiality, MAX(CASE WHEN dimension = 'materiality' THEN confidence END) AS materiality_conf,
       MAX(CASE WHEN dimension = 'consistency' THEN score END) AS consistency, MAX(CASE WHEN dimension = 'consistency' THEN confidence END) AS consistency_conf
FROM {v_claims} c LEFT JOIN {v_scores} s ON s.document_id = c.document_id AND s.claim_id = c.claim_id GROUP BY ALL""",
    "v_rel": """SELECT document_id, claim_id, COUNT(*) AS n_links, MAX(CASE WHEN relation = 'contradicts' THEN 1 ELSE 0 END) AS has_contra,
       MAX(CASE WHEN relation = 'supports' THEN 1 ELSE 0 END) AS has_support, MAX(CASE WHEN relation = 'contradicts_framing' THEN 1 ELSE 0 END) AS has_framing,
       COALESCE(MIN(CASE WHEN dec = 1 THEN tier END), MIN(tier)) AS best_tier
FROM (SELECT *, MAX(CASE WHEN relation IN ('supports', 'contradicts', 'contradicts_framing') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id, claim_id, evidence_id) AS dec FROM {v_links}) GROUP BY document_id, claim_id""",
    "v_verdicts": """SELECT *, CASE WHEN COALESCE(has_contra, 0) = 1 AND ((COALESCE(support, 0) >= 0.7 AND COALESCE(support_conf, 0) >= 0.6)
            OR (COALESCE(consistency, 0) >= 0.7 AND COALESCE(consistency_conf, 0) >= 0.6)) THEN 'contradicted'
        WHEN COALESCE(clarity, 0) >= 0.7 OR (COALESCE(support, 0) BETWEEN 0.4 AND 0.6 AND COALESCE(support_conf, 0) < 0.6) THEN 'unsubstantiated'
        WHEN likelihood > 0.5 THEN 'misleading_by_framing' ELSE 'supported' END AS category,
     ROUND(LEAST(1e0, GREATEST(0e0, CASE WHEN deciding IS NULL THEN 0.1 ELSE
        LEAST(GREATEST(LEAST(base_conf, cap) - 0.05 - CASE WHEN has_support = 1 AND has_contra = 1 THEN 0.1 ELSE 0 END, min_conf - 0.1), max_conf) END)), 2) AS confidence
FROM (SELECT *, LEAST(CASE WHEN n_links IS NULL THEN 0.55 WHEN deciding <> 'clarity' THEN CASE best_tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 WHEN 4 THEN 0.75 ELSE 0.65 END ELSE 1.0 END,
           CASE WHEN n_dims < 4 THEN 0.5 ELSE 1.0 END) AS cap,
        CASE deciding WHEN 'clarity' THEN clarity_conf WHEN 'support' THEN support_conf WHEN 'materiality' THEN materiality_conf ELSE consistency_conf END AS base_conf
   FROM (SELECT w.*, r.n_links, r.has_contra, r.has_support, r.has_framing, r.best_tier,
        COALESCE(GREATEST(clarity, support, materiality, consistency), 0.5) AS likelihood,
        d.deciding, (clarity IS NOT NULL)::INT + (support IS NOT NULL)::INT + (materiality IS NOT NULL)::INT + (consistency IS NOT NULL)::INT AS n_dims,
        LEAST(COALESCE(clarity_conf, 0), COALESCE(support_conf, 0), COALESCE(materiality_conf, 0), COALESCE(consistency_conf, 0)) AS min_conf,
        GREATEST(COALESCE(clarity_conf, 0), COALESCE(support_conf, 0), COALESCE(materiality_conf, 0), COALESCE(consistency_conf, 0)) AS max_conf
      FROM {v_wide} w LEFT JOIN {v_rel} r ON r.document_id = w.document_id AND r.claim_id = w.claim_id
      LEFT JOIN (SELECT document_id, claim_id, dimension AS deciding FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id, claim_id
          ORDER BY score DESC, confidence, CASE dimension WHEN 'clarity' THEN 0 WHEN 'support' THEN 1 WHEN 'materiality' THEN 2 ELSE 3 END) AS k FROM {v_scores}) WHERE k = 1) d
        ON d.document_id = w.document_id AND d.claim_id = w.claim_id))""",
    "v_rows": """SELECT document_id, 'headline' AS profile, CAST(claim_id AS VARCHAR) AS target, likelihood AS score, confidence, prominence FROM {v_verdicts}
UNION ALL SELECT s.document_id, s.dimension, CAST(s.claim_id AS VARCHAR), s.score, s.confidence, c.prominence FROM {v_scores} s JOIN {v_claims} c ON c.document_id = s.document_id AND c.claim_id = s.claim_id
UNION ALL SELECT document_id, 'completeness', omission_id, score, confidence, 1e0 FROM {v_omissions}""",
    "v_header": """SELECT document_id, profile, ROUND(COALESCE(SUM(score * w * score * score) / NULLIF(SUM(w * score * score), 0), 0), 2) AS score,
       ROUND(COALESCE(SUM(confidence * w * score * score) / NULLIF(SUM(w * score * score), 0), SUM(confidence * w) / SUM(w)), 2) AS confidence
FROM (SELECT *, GREATEST(prominence * confidence, 1e-6) AS w FROM {v_rows}) GROUP BY document_id, profile""",
    "v_dated": """SELECT d.company_id, d.document_id, d.doc_date, h.score, h.confidence,
       CASE WHEN d.doc_date IS NULL THEN 0.5 ELSE POW(0.5, (MAX(d.doc_date) OVER (PARTITION BY d.company_id) - d.doc_date) / 730e0) END AS recency
FROM {v_documents} d JOIN {v_header} h ON h.document_id = d.document_id AND h.profile = 'headline'""",
}
_NAME = re.compile(r"\{(\w+)\}")


def _score_rows() -> list[str]:
    """The four scores of a row of v_base, as structs."""
    two = lambda e: f"round({e}, 2)"
    rows = {
        "clarity": (two("d * 1e1"), two("3e-1 + (s % 8) / 1e1")), "support": (two("t * 125e-1"), two("3e-1 + (p % 8) / 1e1")),
        "materiality": (two("q / 5e1"), two("3e-1 + claim_id / 1e1")), "consistency": (two("(s % 11) / 1e1"), two("3e-1 + (s % 5) / 1e1")),
    }
    return [f"named_struct('dimension', '{k}', 'score', {a}, 'confidence', {b})" for k, (a, b) in rows.items()]


def _scores(base: DataFrame) -> DataFrame:
    return base.selectExpr("document_id", "claim_id", "s", f"inline(array({', '.join(_score_rows())}))").where("dimension <> 'consistency' or s % 13 <> 0").drop("s")


def _nested(lineitem: DataFrame) -> DataFrame:
    """v_claims with their v_scores and v_links as arrays, from one pass over lineitem, dealt out by document."""
    rows = lineitem.selectExpr(
        "l_orderkey AS document_id", "l_linenumber AS claim_id", "l_discount", "l_tax", "l_quantity", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus"
    ).repartition("document_id")
    link = """CASE WHEN l_partkey % 3 <> 0 THEN named_struct('evidence_id', concat('E', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)), 'tier', CAST(1 + l_suppkey % 5 AS INT),
        'relation', CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'contradicts' WHEN l_returnflag = 'R' THEN 'contradicts_framing' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'supports'
        WHEN l_returnflag = 'A' THEN 'context' WHEN l_linestatus = 'F' THEN 'criteria' ELSE 'precedent' END) END"""
    agg = {"d": "min(l_discount)", "t": "min(l_tax)", "q": "min(l_quantity)", "s": "min(l_suppkey)", "p": "min(l_partkey)", "pm": "max(l_partkey)", "links": f"collect_set({link})"}
    g = rows.groupBy("document_id", "claim_id").agg(*(F.expr(e).alias(n) for n, e in agg.items()))
    kept = "filter(array({}), x -> x.dimension <> 'consistency' or s % 13 <> 0)".format(", ".join(_score_rows()))
    return g.selectExpr(
        "document_id", "claim_id", "CASE WHEN claim_id = 1 THEN 1e0 WHEN claim_id = 7 THEN 3e-1 ELSE 6e-1 END AS prominence",
        "CASE pm % 5 WHEN 0 THEN 'factual' WHEN 1 THEN 'commitment' WHEN 2 THEN 'comparative' WHEN 3 THEN 'vague_attribute' ELSE 'certification' END AS type", f"{kept} AS scores", "links",
    )


class Tables:
    """Tables and views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "nested_claims":
            return _nested(self.lineitem)
        if name not in VIEWS:
            return self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        if name == "v_scores":  # the same rows as the union below, from one pass over the base
            return _scores(self.v_base)
        sql = VIEWS[name]
        return self._spark.sql(sql, **{t: getattr(self, t) for t in dict.fromkeys(_NAME.findall(sql))})


def _needed(sql: str, have: dict[str, str]) -> None:
    for name in dict.fromkeys(re.findall(r"\bv_\w+", sql)):
        if name in VIEWS and name not in have:
            _needed(VIEWS[name], have)
            have[name] = _ties(_NAME.sub(r"\1", VIEWS[name]))


def _ties(sql: str) -> str:
    """``round(x, n)`` with the same hair added as in ``operators.verdict.rounded``."""
    out = []
    for m in re.finditer(r"(?i)\bround\(", sql):
        depth, i, comma = 1, m.end(), -1
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        if comma > 0:
            out.append((m.end(), "("), )
            out.append((comma, ") + 1e-9"))
    for place, text in sorted(out, reverse=True):
        sql = sql[:place] + text + sql[place:]
    return sql


def with_views(sql: str) -> str:
    """``sql`` for DuckDB with the views it names in front."""
    sql = _ties(sql)
    have: dict[str, str] = {}
    _needed(sql, have)
    if not have:
        return sql
    heads = ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in have.items())  # each view once, however often it is named
    body = sql.lstrip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {heads},\n{body[15:]}"
    return f"WITH {heads},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads}\n{body}"
