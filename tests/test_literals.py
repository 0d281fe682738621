"""Small cases with known answers."""

import datetime

import pytest
from pyspark.sql import functions as F

from auditgrain.functions import text as tx
from auditgrain.operators import calibration as cal
from auditgrain.operators import company as co
from auditgrain.operators import spans as sp
from auditgrain.operators import summary as su
from auditgrain.operators import verdict as ve


def lehmer(spark, rows):
    df = spark.createDataFrame([(1, str(i), *r) for i, r in enumerate(rows)], "k int, target string, score double, confidence double, prominence double")
    return su.lehmer(df, ["k"]).first(), su.drivers(df, ["k"]).collect()


def test_lehmer(spark):
    r, d = lehmer(spark, [(0.9, 0.8, 1.0), (0.1, 0.8, 1.0), (0.1, 0.8, 1.0)])
    assert 0.367 < r.score <= 0.9 and d[0].drivers[0] == "0"
    assert lehmer(spark, [(0.4, 0.8, 1.0)])[0].score == 0.4
    r, d = lehmer(spark, [(0.0, 0.9, 1.0), (0.0, 0.7, 1.0)])
    assert r.score == 0 and r.confidence == 0.81 and d == []
    assert lehmer(spark, [(0.9, 0.8, 1.0)] + [(0.05, 0.8, 0.3)] * 60)[0].score >= 0.8


def wide(spark, **scores):
    cols, vals = [], []
    for d in ("clarity", "support", "materiality", "consistency"):
        s, c = scores.get(d, (0.2, 0.8))
        cols += [f"{d} double", f"{d}_conf double"]
        vals += [s, c]
    links = scores.get("links")
    return spark.createDataFrame([(*vals, scores.get("type", "factual"), links and [x for x, _ in links], links and min(t for _, t in links), links and len(links))], ", ".join(cols) + ", type string, relations array<string>, best_tier int, n_items int")


@pytest.mark.parametrize("scores,contra,want", [
    ({"support": (0.8, 0.7)}, True, "contradicted"), ({"support": (0.8, 0.7)}, False, "misleading_by_framing"), ({"support": (0.8, 0.5)}, True, "misleading_by_framing"),
    ({"clarity": (0.7, 0.8)}, False, "unsubstantiated"), ({"support": (0.5, 0.5)}, False, "unsubstantiated"), ({"support": (0.5, 0.7)}, False, "supported"),
    ({"materiality": (0.6, 0.8)}, False, "misleading_by_framing"), ({"materiality": (0.5, 0.8)}, False, "supported"), ({}, False, "supported"),
])
def test_category(spark, scores, contra, want):
    assert wide(spark, **scores).select(ve.category(F.lit(contra)).alias("c")).first().c == want


def test_deciding(spark):
    assert wide(spark, clarity=(0.5, 0.9), materiality=(0.5, 0.6)).select(ve.deciding_dimension().alias("d")).first().d == "materiality"
    assert wide(spark, clarity=(0.5, 0.8), materiality=(0.5, 0.8)).select(ve.deciding_dimension().alias("d")).first().d == "clarity"


@pytest.mark.parametrize("scores,want", [
    ({"support": (0.9, 0.8), "links": [("supports", 1)]}, 0.75), ({"clarity": (0.1, 0.8), "support": (0.5, 0.4), "materiality": (0.1, 0.8), "consistency": (0.1, 0.5)}, 0.35),
    ({"support": (0.9, 0.9), "links": [("supports", 1), ("contradicts", 1)]}, 0.75), ({d: (0.3, 0.95) for d in ("clarity", "support", "materiality", "consistency")}, 0.85),
])
def test_confidence(spark, scores, want):
    assert wide(spark, **scores).select(ve.verdict_confidence().alias("c")).first().c == pytest.approx(want)


def test_metrics(spark):
    cases = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.2, 1), (0.9, 0), (0.1, 0), (0.7, None), (None, 1)], "likelihood double, label int")
    m = cal.classification_metrics(cases).first()
    assert (m.tp, m.fn, m.fp, m.tn, m.unlabelled, m.failed) == (2, 1, 1, 1, 1, 1)
    assert m.precision == m.recall == m.f1 == pytest.approx(2 / 3) and m.accuracy == pytest.approx(0.6)
    c = cal.calibration_curve(spark.createDataFrame([(0.1, 0), (0.15, 0), (0.85, 1), (0.95, 1), (0.9, 0), (1.0, 1)], "likelihood double, label int")).orderBy("bin").collect()
    assert [x.n for x in c] == [2, 4]


def test_trend(spark):
    d = datetime.date
    docs = spark.createDataFrame([(1, 10, d(2021, 5, 17)), (1, 11, d(2022, 8, 30)), (2, 20, d(2019, 2, 3)), (3, 30, d(2020, 6, 6)), (3, 31, d(2020, 6, 6)), (4, 40, d(2018, 1, 1)), (4, 41, d(2019, 1, 1))], "company_id int, document_id int, doc_date date")
    head = spark.createDataFrame([(10, 0.31, 0.7), (11, 0.75, 0.6), (20, 0.44, 0.6), (30, 0.15, 0.7), (31, 0.65, 0.7), (40, 0.9, 0.9), (41, 0.5, 0.9)], "document_id int, score double, confidence double")
    t = {r.company_id: r for r in co.trend(docs, head).collect()}
    assert (t[1].direction, t[1].change, t[1].span_days) == ("worsening", 0.44, 470) and t[1].confidence <= 0.35
    assert t[2].direction == "undetermined" and t[2].change is None and t[4].direction == "improving"
    assert t[3].span_days == 0 and t[3].per_year is None


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(tx.find_all(F.lit("aaaa"), F.lit("aa"))) == [0, 1, 2] and one(tx.find_all(F.lit("abcab"), F.lit("ab"))) == [0, 3] and one(tx.find_all(F.lit("x"), F.lit(""))) == []
    assert one(tx.find_all(F.lit("a.b\\Ea.b"), F.lit(".b\\E"))) == [1]
    assert one(tx.canonical_line(F.lit("  a  b​\n c "))) == "a b c" and one(tx.canonical_line(F.lit("é"))) == "é"
    for text, rule in (("", "empty"), ("a\rb", "carriage_return"), ("a\tb", "other_whitespace"), ("a  b", "double_space"), ("a \nb", "space_at_line_edge"), ("a\n\n\nb", "blank_line_run"), (" a", "outer_whitespace")):
        assert rule in one(tx.canonical_violations(F.lit(text)))
    assert one(tx.canonical_violations(F.lit("a b\n\nc"))) == []
    assert one(tx.company_slug(F.lit("Bjørn & Søn ÆB"))) == "bjorn-son-aeb" and one(tx.org_from_host(F.lit("https://www.acme.co.uk/x"))) == "Acme"
    assert one(tx.states_value(F.lit("up 3.7 points"), F.lit(3.68))) and not one(tx.states_value(F.lit("up 13.7 points since 2011"), F.lit(3.68))) and one(tx.states_value(F.lit("48,310 tonnes"), F.lit(48310.0)))
    assert one(tx.short_title(F.lit("A - b - Site"))) == "A - b"


def test_reanchor(spark):
    text = "a b c. a b d. a b c."
    schema = "k int, text string, needle string, start int, end int, context string, occurrence int, old_text string"
    rows = [(1, text, "b", 2, 3, None, None, None), (2, text, "a b", 90, 93, None, 3, None), (3, text, "d", 90, 91, None, None, None), (4, text, "a b", 90, 93, None, None, None), (5, text, "a b c", 15, 20, None, None, "x" + text)]
    got = {r.k: (r.new_start, r.method) for r in sp.reanchor(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (2, "offset"), 2: (14, "occurrence"), 3: (11, "unique"), 4: (None, None), 5: (14, "same_occurrence")}
