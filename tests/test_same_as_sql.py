"""Queries and their SQL on small tables with the cases that told them apart."""

import time

import duckdb
import pytest

from auditgrain.plans.registry import ORACLE, QUERIES


@pytest.fixture
def both(spark, tmp_path):
    """Writes tables (name: SELECT) and gives the sorted rows of a query and of its SQL over them."""
    def run(name, **tables):
        c = duckdb.connect()
        for t, sql in tables.items():
            if not (tmp_path / f"{t}.parquet").exists():
                c.sql(sql).write_parquet(str(tmp_path / f"{t}.parquet"))
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        rel = c.sql(ORACLE[name])
        ours = QUERIES[name](spark, str(tmp_path)).select(*rel.columns).collect()
        order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
        return order(ours), order(rel.fetchall())

    return run


def test_quotes_are_found_in_time(spark):
    """Forms and texts are worked out once for a pair: forty pairs took about ten seconds of a core when each step of a lambda did it anew."""
    from auditgrain.operators import spans as sp

    quote = "Words that a report may state, and more of them. " * 4
    rows = [(d, d % 3, quote, ("x" * 50 + " ") * 40 + quote.upper()) for d in range(40)]
    start = time.time()
    got = sp.locate_quotes(spark.createDataFrame(rows, "document_id long, owner_id long, quote string, text string")).collect()
    assert [r.start for r in got] == [2040] * 40 and time.time() - start < 30


def test_short_title_cuts_at_the_last_separator(both):
    """Separators that share a blank: the last one counts."""
    pages = "SELECT page_id, 'http://x.example/' AS url, '<title>' || title || '</title>' AS html FROM (VALUES (1, 'a | b |'), (7, 'a - - b'), (8, 'plain'), (14, 'a | | b'), (2, 'x -')) v(page_id, title)"
    ours, theirs = both("f20_short_title", pages=pages)
    assert ours == theirs and (7, "a -") in ours and (1, "a | b |") in ours


_DOCS = "SELECT doc_id, text, 'en' AS lang, 's' AS source, length(text) AS n_chars FROM (VALUES (1, 'He said: THE OLD BRIDGE FELL LAST NIGHT.!! So.'), (2, 'line' || chr(10) || 'The \u201cold\u201d bridge \u2013 it fell. Down'), (3, 'the old bridge fell last night, the old bridge fell last night.'), (4, 'no quote'), (5, 'the old  bridge fell last night')) v(doc_id, text)"
_ITEMS = "SELECT * FROM (VALUES (10, 'The old bridge fell last night.'), (11, '\"old\" bridge - it fell.'), (12, 'the old bridge fell last night')) v(item_id, text)"


def _quotes(both, name):
    ours, theirs = both(name, documents=_DOCS, benchmark=_ITEMS)
    assert len(ours) == 5 and ours == theirs
    return ours


def test_located_in_any_case(both):
    """Case and typography aside, and each quote at the first place that none before took."""
    assert {r[:3] for r in _quotes(both, "j10_locate_quotes")} == {(1, 10, 9), (1, 12, 9), (2, 11, 9), (3, 10, 0), (3, 12, 32)}


def test_orphans_of_quotes_in_any_case(both):
    assert (2, 11, 1) in _quotes(both, "j12_attach_orphans")


def test_regions_of_quotes_in_any_case(both):
    assert (2, 11, "P2", 0.6) in [(*r[:3], float(r[3])) for r in _regions_of(both)]


def _regions_of(both):
    ours, theirs = both("j4_locate_region", documents=_DOCS, benchmark=_ITEMS)
    assert [(*r[:3], float(r[3])) for r in ours] == [(*r[:3], float(r[3])) for r in theirs] and len(ours) == 5
    return ours


def test_overlaps_of_quotes_in_any_case(both):
    assert (1, 10, 0, 1.0) in _quotes(both, "j5_overlap_pairs")


def test_whole_numbers_beyond_a_double(both):
    ours, theirs = both("p9_lenient_int_all", documents="SELECT 1::BIGINT AS doc_id, 'no 9859476043669044, 3' AS text UNION ALL SELECT 2, 'no 9,007,199,254,740,993 x'")
    assert ours == theirs and (2, 9007199254740993) in ours


def test_captures_of_one_second(both):
    """A stamp has 14 digits: captures of one second are one, with the least digest."""
    events = "SELECT i AS event_id, i % 2 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 300) MILLISECOND AS ts, CASE i * 7 % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'signup' END AS event_type, 1.0 AS value, '' AS props FROM range(200) t(i)"
    ours, theirs = both("s10_capture_history", events=events)
    assert ours == theirs and len({r[:2] for r in ours}) == len(ours)


def test_severities_equal_but_for_rounding(spark):
    """1.0 x 0.3 x 0.6 and 0.6 x 0.3 x 1.0 of a recency: the score decides, whatever the last bits say."""
    import datetime

    from auditgrain.operators import company as co

    docs = [(d, 1, datetime.date(2024, 1, 1) - datetime.timedelta(days=37 * d)) for d in range(40)]
    rows = [(d, "headline", str(k), s, c, p) for d in range(40) for k, s, c, p in ((1, 0.8, 0.5, 0.6), (2, 1.0, 0.4, 0.6))]
    got = co.company_findings(spark.createDataFrame(rows, "document_id int, profile string, target string, score double, confidence double, prominence double"),
                              spark.createDataFrame(docs, "document_id int, company_id int, doc_date date"), k=80).orderBy("rank").collect()
    assert [(r.document_id, r.target) for r in got] == [(d, k) for d in range(40) for k in ("2", "1")]


def test_every_case_with_every_other_entry(both):
    tables = {"documents": "SELECT i AS doc_id, 10 + i AS n_chars FROM range(6) t(i)", "labels": "SELECT i AS doc_id, i % 2 AS quality, 0 AS toxic FROM range(6) t(i)",
              "benchmark": "SELECT i AS item_id, 'text' AS text FROM range(9) t(i)", "pages": "SELECT i AS page_id, 'http://x.example/' || i AS url, '' AS html FROM range(3) t(i)"}
    ours, theirs = both("j15_leave_one_out", **tables)
    assert ours == theirs and len(ours) == 6 * 8


def test_every_page_with_every_other_ruling(both):
    tables = {"benchmark": "SELECT i AS item_id, 'text' AS text FROM range(9) t(i)", "pages": "SELECT i AS page_id, CASE WHEN i = 4 THEN NULL ELSE 'http://x.example/' || i // 2 || CASE WHEN i = 1 THEN '/' ELSE '' END END AS url, '' AS html FROM range(6) t(i)"}
    ours, theirs = both("j14_hold_out", **tables)
    assert ours == theirs and len(ours) == 6 * 9 - 9


def test_rows_of_rare_words_are_not_repeated(spark, monkeypatch):
    """Words of few rows meet in one place; those of many in slices, with the same pairs."""
    from auditgrain.operators import matching as ma

    rows = lambda odd: spark.createDataFrame([(d, i, [f"w{d}-{(i * 7 + j * 11) % 60}" for j in range(20)]) for d in range(20) for i in range(odd, 40, 2)], "document_id int, id int, words array<string>")

    def shuffled():
        sc = spark.sparkContext
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._gateway.jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        got = {tuple(r) for r in ma.word_pairs(rows(1), rows(0)).collect()}
        assert shuffled() - before < 150_000  # 800 cards of 20 words; 32 copies of 16 words of each alone would be 409,600
        monkeypatch.setattr(ma, "SLICE", 2)
        assert got and got == {tuple(r) for r in ma.word_pairs(rows(1), rows(0), slices=5).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scores_are_checked_without_joins(spark):
    """Q10 on odd rows: repeated claims, unknown dimensions, null keys and ids cited by several scores; each score is counted."""
    from collections import Counter

    from auditgrain.config import DIMENSIONS
    from auditgrain.operators import validate as va

    claims = [(1, 1), (1, 2), (1, 3), (1, 3), (2, 1), (None, 1), (3, 1)]
    scores = [(1, 1, d, ["E1"]) for d in DIMENSIONS] + [(1, 2, "clarity", ["E1", "EX"])] * 2 + [(1, 2, "support", ["E1", "EX"]), (1, 3, "mood", None), (1, 3, "mood", None), (1, 3, None, []), (1, 3, None, ["EX"]), (9, 1, "clarity", ["EX"]), (9, 1, "clarity", ["EX"]), (9, 1, "tone", None), (None, 1, "clarity", None), (3, 1, "mood", ["E1"])]
    evidence = [(1, "E1"), (1, "E1"), (2, "EX")]
    want = Counter()
    for c in claims:
        for d in DIMENSIONS:
            if None in c or not any((s[0], s[1], s[2]) == (*c, d) for s in scores):
                want[(c[0], c[1], f"no {d}")] += 1
    for (a, b, d), n in Counter(s[:3] for s in scores).items():
        if n > 1:
            want[(a, b, d and f"repeated {d}")] += 1
    for a, b, _, ids in scores:
        if a is None or (a, b) not in claims:
            want[(a, b, "unknown claim")] += 1
        for i in ids or []:
            if (a, i) not in evidence:
                want[(a, b, f"unknown evidence {i}")] += 1
    s = spark.createDataFrame(scores, "document_id long, claim_id long, dimension string, evidence_ids array<string>")
    c = spark.createDataFrame(claims, "document_id long, claim_id long")
    out = va.check_q10(c, s, spark.createDataFrame(evidence, "document_id long, evidence_id string"))
    assert Counter((r.document_id and int(r.document_id), int(r.entity_id), r.detail) for r in out.collect()) == want
    assert "Join" not in va.check_q10(c, s)._jdf.queryExecution().executedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_judges_and_contributions_without_joins(spark, sf):
    """Claims that carry their rows need no join: the same as from separate tables."""
    from pyspark.sql import functions as F

    from auditgrain.operators import summary as su
    from auditgrain.operators import verdict as ve
    from auditgrain.plans import registry
    from auditgrain.plans.views import Tables

    t = Tables(spark, sf)
    v = ve.derive_verdicts(t.nested_claims)
    own = F.when(F.col("score") > 0.6, "contradicted").when(F.col("score") > 0.3, "misleading_by_framing").otherwise("supported")
    judged = registry.QUERIES["a7_judge_consistency"](spark, sf)
    assert "Join" not in _plan(judged)
    assert set(judged.collect()) == set(ve.judge_consistency(t.v_scores.select(*ve.KEY, own.alias("own_category")), v).collect())
    a9 = registry.QUERIES["a9_contributions"](spark, sf)
    assert "Join" not in _plan(a9)
    rows = su.contributions(su.profile_rows(t.v_claims, t.v_scores, v, t.v_omissions), ["document_id", "profile"])
    assert {r[:3] + r[4:] for r in map(tuple, a9.collect())} == {tuple(r) for r in rows.select("document_id", "profile", "target", "rank").collect()}
    odd = spark.createDataFrame([(1, 1, ["a", "a", "b"], "b"), (1, 2, [], "a"), (1, 3, ["a", None, None], "a")], "document_id int, claim_id int, own_categories array<string>, category string")
    assert {tuple(r) for r in ve.nested_consistency(odd).collect()} == {(1, 1, 0.33, 0.67), (1, 3, 0.33, 0.67)}


def test_checks_and_changes_read_once(spark, sf):
    from auditgrain.operators import company as co
    from auditgrain.plans import registry

    assert _plan(registry.QUERIES["q12_derived"](spark, sf)).count("Scan parquet") == 1
    assert _plan(registry.QUERIES["w5_dimension_change"](spark, sf)).count("lineitem.parquet") == 1
    docs = spark.createDataFrame([(1, 1, 10), (1, 2, 20), (1, 3, None), (2, 4, 5), (3, 5, 1), (3, 6, 1)], "company_id int, document_id int, doc_date int")
    head = spark.createDataFrame([(1, "x", 0.5), (1, "gone", 0.5), (2, "x", 0.8), (2, "new", 0.25), (3, "x", 0.9), (4, "x", 0.1), (5, "x", 0.3)], "document_id int, profile string, score double")
    assert {tuple(r) for r in co.dimension_change(docs, head).collect()} == {(1, "x", 0.3), (1, "new", 0.25)}
