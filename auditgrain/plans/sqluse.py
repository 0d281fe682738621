"""The audit's tables and formulas for people who write SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..config import CATEGORIES, DEFAULT, DIMENSIONS, TIER_CAP
from .views import VIEWS, Tables


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("v_claims", "v_scores", "v_links", "v_documents", "v_omissions", "v_cases", "v_log")) -> None:
    """Temporary views of the audit's tables, under their names."""
    tables = Tables(spark, sf_dir)
    for name in names:
        assert name in VIEWS
        getattr(tables, name).createOrReplaceTempView(name)


def lehmer_sql(score: str, weight: str, value: str | None = None, power: float = DEFAULT.power) -> str:
    """The severity-leaning mean as a SQL aggregate: of ``score``, or of ``value`` with the same weights; null where no score is above 0."""
    w = f"{weight} * power({score}, {power - 1})"
    return f"sum({value or score} * {w}) / nullif(sum({w}), 0)"


def _functions() -> dict[str, str]:
    """The formulas of a claim's verdict as bodies of SQL functions; Spark inlines them, so they cost what the expressions do."""
    scores = ", ".join(f"{d} DOUBLE" for d in DIMENSIONS)
    confs = ", ".join(f"{d}_conf DOUBLE" for d in DIMENSIONS)
    zero = lambda c: f"coalesce({c}, 0)"
    sure = lambda d: f"({zero(d)} >= 0.7 AND {zero(d + '_conf')} >= 0.6)"
    deciding = "array_max(array_compact(array(" + ", ".join(
        f"CASE WHEN {d} IS NOT NULL THEN named_struct('s', {d}, 'c', -{d}_conf, 'o', {-i}, 'd', '{d}') END" for i, d in enumerate(DIMENSIONS)) + "))).d"
    base = "CASE deciding " + " ".join(f"WHEN '{d}' THEN {d}_conf" for d in DIMENSIONS) + " END"
    tier = "CASE best_tier " + " ".join(f"WHEN {k} THEN {v}D" for k, v in TIER_CAP.items()) + " END"
    cap = f"least(CASE WHEN n_items IS NULL THEN 0.55D WHEN deciding <> '{DIMENSIONS[0]}' THEN {tier} ELSE 1D END, CASE WHEN {' AND '.join(f'{d} IS NOT NULL' for d in DIMENSIONS)} THEN 1D ELSE 0.5D END)"
    low, high = (f"{f}({', '.join(zero(d + '_conf') for d in DIMENSIONS)})" for f in ("least", "greatest"))
    value = f"least(greatest(least({base}, {cap}) - 0.05D - CASE WHEN supports AND contradicts THEN 0.1D ELSE 0D END, {low} - 0.1D), {high})"
    supported, framing, unsubstantiated, contradicted = CATEGORIES
    return {
        "audit_clamp(x DOUBLE) RETURNS DOUBLE": "round(least(1D, greatest(0D, x)) + 1e-9D, 2)",
        f"audit_likelihood({scores}) RETURNS DOUBLE": f"coalesce(greatest({', '.join(DIMENSIONS)}), 0.5D)",
        f"audit_category({scores}, {confs}, has_contradiction BOOLEAN) RETURNS STRING":
            f"CASE WHEN has_contradiction AND ({sure('support')} OR {sure('consistency')}) THEN '{contradicted}' WHEN {zero('clarity')} >= 0.7 OR ({zero('support')} BETWEEN 0.4 AND 0.6 AND {zero('support_conf')} < 0.6) THEN '{unsubstantiated}'"
            f" WHEN greatest({', '.join(zero(d) for d in DIMENSIONS)}) > 0.5 THEN '{framing}' ELSE '{supported}' END",
        f"audit_deciding({scores}, {confs}) RETURNS STRING": deciding,
        f"audit_confidence(deciding STRING, {scores}, {confs}, best_tier INT, n_items BIGINT, supports BOOLEAN, contradicts BOOLEAN) RETURNS DOUBLE": f"audit_clamp(CASE WHEN deciding IS NULL THEN 0.1D ELSE {value} END)",
        "audit_weight(prominence DOUBLE, confidence DOUBLE) RETURNS DOUBLE": f"greatest(coalesce(prominence, {DEFAULT.default_prominence}D) * confidence, 1e-6D)",
    }


class LexiconScorer:
    """``SELECT * FROM audit_score(TABLE(texts), words => 'a,b')``: a score for every row of a table, from SQL.

    The table needs a column ``text``; its other columns are passed on.  ``score`` is the share of its words that stand in ``words``, ``confidence`` grows with their number.  Own scorers
    follow the same form: ``analyze`` names the columns, ``eval`` scores a row."""

    def __init__(self, analyzed: AnalyzeResult | None = None):
        self.words: set[str] | None = None

    @staticmethod
    def analyze(rows: AnalyzeArgument, words: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name: f.dataType for f in rows.dataType.fields}
        if "text" not in fields:
            raise ValueError("audit_score needs a column named text")
        if not words.isConstantExpression or words.value is None:
            raise ValueError("words must be a constant list")
        from pyspark.sql.types import DoubleType, StructType

        schema = StructType([f for f in rows.dataType.fields if f.name != "text"]).add("score", DoubleType()).add("confidence", DoubleType())
        return AnalyzeResult(schema=schema)

    def eval(self, rows: Row, words: str) -> Iterator[tuple]:
        if self.words is None:
            self.words = {w.strip().lower() for w in words.split(",")}
        have = (rows["text"] or "").lower().split()
        hit = sum(w in self.words for w in have)
        rest = [rows[n] for n in rows.__fields__ if n != "text"]
        yield (*rest, round(hit / len(have), 6) if have else 0.0, min(0.9, 0.5 + len(have) / 100))


def register_functions(spark: SparkSession) -> None:
    """The formulas as temporary SQL functions, and ``audit_score`` as a table function."""
    for head, body in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("audit_score", F.udtf(LexiconScorer))
