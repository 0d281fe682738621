"""Operators whose reference form is a loop, held against that loop; file sources and user scorers."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from auditgrain.operators import blocks as bl
from auditgrain.operators import eventlog as ev
from auditgrain.operators import matching as ma
from auditgrain.operators import mining as mi
from auditgrain.operators import scorers
from auditgrain.plans.queries_mining import CLAIM_WORDS, MARKS
from auditgrain.plans.registry import QUERIES
from auditgrain.sources import logs


def test_greedy_match(spark):
    rows = [(d, a, b, abs(a * 7 % 5 - b * 3 % 4)) for d in range(3) for a in range(6) for b in range(6) if (a + b + d) % 3]
    got = ma.greedy_match(spark.createDataFrame(rows, "d int, a int, b int, gap int"), [F.col("gap"), F.col("a"), F.col("b")], ["d", "a"], ["d", "b"]).collect()
    want, used = set(), set()
    for d, a, b, g in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if ("a", d, a) not in used and ("b", d, b) not in used:
            used |= {("a", d, a), ("b", d, b)}
            want.add((d, a, b, g))
    assert {tuple(r) for r in got} == want


def test_greedy_match_of_a_long_chain(spark):
    """Two hundred pairs, each better than the next and sharing a side with it."""
    rows = [(1, i // 2 + i % 2, i // 2, i) for i in range(400)]
    got = ma.greedy_match(spark.createDataFrame(rows, "d int, a int, b int, gap int"), [F.col("gap"), F.col("a"), F.col("b")], ["d", "a"], ["d", "b"]).collect()
    assert {tuple(r) for r in got} == {r for r in rows if r[3] % 2 == 0}
    alone = ma.greedy_match(spark.createDataFrame([(1, 2, 0), (1, 3, 1), (4, 2, 2), (4, 3, 3)], "a int, b int, gap int"), [F.col("gap")], ["a"], ["b"]).collect()
    assert {(r.a, r.b) for r in alone} == {(1, 2), (4, 3)}


def test_greedy_match_in_rounds(spark):
    """Groups beyond the limit go through rounds: random pairs with null keys, one hot side, and chains that stop the rounds."""
    rng = random.Random(11)
    rows = {(d, rng.choice([None, *range(40)]), rng.choice([0, 0, 0, *range(40)])): rng.randint(0, 9) for d in (1, 2) for _ in range(600)}
    rows |= {(3, i // 2 + i % 2, i // 2): i for i in range(300)}
    rows = [(*k, g) for k, g in rows.items()]
    table = spark.createDataFrame(rows, "d int, a int, b int, gap int")
    want, used = set(), set()
    low = lambda v: (v is not None, v)
    for d, a, b, g in sorted(rows, key=lambda r: (r[3], low(r[1]), low(r[2]))):
        if ("a", d, a) not in used and ("b", d, b) not in used:
            used |= {("a", d, a), ("b", d, b)}
            want.add((d, a, b, g))
    order = [F.col("gap"), F.col("a"), F.col("b")]
    for limit in (0, 10, 350):
        got = ma.greedy_match(table, order, ["d", "a"], ["d", "b"], group_rows=limit).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    alone = table.where("d = 1").drop("d")
    whole = ma.greedy_match(alone, order, ["a"], ["b"], group_rows=5).collect()
    assert {(1, *r) for r in whole} == {r for r in want if r[0] == 1}
    assert ma.greedy_match(table.limit(0), order, ["d", "a"], ["d", "b"], group_rows=0).count() == 0


def test_quote_attribution(spark):
    kinds = "quote paragraph paragraph paragraph paragraph quote long paragraph heading paragraph quote paragraph".split()
    rows = [(1, i, "paragraph" if k == "long" else k, 1 if k == "heading" else None, "a b c" if k != "long" else "word " * 12) for i, k in enumerate(kinds)]
    got = [r.kind for r in bl.quote_attribution(spark.createDataFrame(rows, "document_id int, block_no int, kind string, level int, text string")).orderBy("block_no").collect()]
    want, left = [], 0
    for _, _, kind, _, text in rows:
        if kind == "quote":
            left = 3
        elif left and kind == "paragraph" and len(text.split()) <= 8:
            kind, left = "caption", left - 1
        else:
            left = 0
        want.append(kind)
    assert got == want


def test_signals(spark, sf):
    claims = mi.mine_claims(spark.read.parquet(f"{sf}/documents.parquet").limit(60), CLAIM_WORDS)
    got = {(r.document_id, r.claim_id, r.kind, r.start, r.end) for r in mi.mine_signals(claims, MARKS).collect()}
    want = set()
    for r in claims.collect():
        for kind, words in MARKS.items():
            for w in words:
                for m in re.finditer(rf"(?<![^\W_]){w}(?![^\W_])", r.text.lower()):
                    want.add((r.document_id, r.claim_id, kind, r.start + m.start(), r.start + m.end()))
    assert got == want


def test_clarity_takes_one_pass(spark, sf):
    """Claims are made once: one scan and one exchange of texts, where each use of the claims made them again."""
    plan = QUERIES["m4_m5_score_clarity"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and not re.search("Join|Window|Sort", plan)


def test_clarity_of_claims(spark, sf):
    """The same as marks in a table of their own, joined back; with claims of every polarity and without marks."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("doc_id", "text")
    more = [(10**6, "The cut since 2015. And the 40% of it. With 7 of them. The and in 2019.\nAnd the rest."), (10**6 + 1, None), (10**6 + 2, " \n. \n")]
    claims = mi.extract_quantities(mi.mine_claims(docs.unionByName(spark.createDataFrame(more, "doc_id long, text string")), CLAIM_WORDS))
    marks = mi.assign_polarity(mi.mine_signals(claims, MARKS), claims)
    polarity = {(r.document_id, r.claim_id): r.polarity for r in marks.collect()}
    want = {(*r[:2], polarity.get(tuple(r[:2])), *r[2:]) for r in mi.score_clarity(claims, marks).collect()}
    rows = [tuple(r) for r in mi.clarity_of_claims(claims, MARKS).collect()]
    assert set(rows) == want and len(rows) == len(want) and {r[2] for r in rows} == {"credit", "benign", "flag", None}
    assert {r[2:5] for r in rows if r[0] == 10**6} == {("credit", "clarity", 0.15), ("benign", "clarity", 0.4), (None, "clarity", 0.15), ("flag", "clarity", 0.8)}


def test_sentences_and_their_places(spark):
    """Against a loop over lines, on texts of blanks, stops and line ends in any order, and on one of 20,000 lines."""
    rng = random.Random(5)
    docs = dict(enumerate("".join(rng.choice("a.!? \n\né\U0001f600\t\r") for _ in range(rng.randint(0, 60))) for _ in range(300)))
    docs[300] = "Some words. More\n" * 20_000
    want = set()
    for d, text in docs.items():
        at, n = 0, 0
        for line in text.split("\n"):
            for piece in re.split(r"(?<=[.!?])(?= )", line):
                if piece.strip(" "):
                    n, start = n + 1, at + len(piece) - len(piece.lstrip(" "))
                    want.add((d, n, start, start + len(piece.strip(" ")), piece.strip(" ")))
                at += len(piece)
            at += 1
    got = mi.sentences(spark.createDataFrame([*docs.items(), (301, None)], "doc_id int, text string"))
    assert dict(got.dtypes)["start"] == "bigint" and {tuple(r) for r in got.collect()} == want


def test_event_log_files(spark, tmp_path):
    (tmp_path / "a1.jsonl").write_text('{"seq": 0, "t_ms": 1, "type": "x", "payload": "p"}\n\n{"t_ms": 2, "type": "y"}\nnot json\n{"seq": 9}\n')
    good, bad = logs.read_event_log(spark, str(tmp_path))
    assert [(r.analysis_id, r.seq, r.type) for r in good.orderBy("seq").collect()] == [("a1", 0, "x"), ("a1", 2, "y")]
    assert good.count() == 2
    assert [(r.line_no, r.error) for r in bad.orderBy("line_no").collect()] == [(4, "not JSON"), (5, "no type")]
    logs.write_event_log(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    c = ev.log_catalogue(good, bad).collect()
    assert c[0].n_events == 2 and c[0].error == "not JSON"


def test_event_log_of_many_analyses(spark, tmp_path):
    """As many files as tasks, not as analyses; each line is whole JSON with its id, and broken ones keep theirs."""
    rows = [(f'a "{i}\\\t/ü', s, s * 10, "x", None if s else f"p{i}") for i in range(60) for s in range(3)]
    events = spark.createDataFrame(rows, "analysis_id string, seq long, t_ms long, type string, payload string")
    for run in ("seq <> 1", "seq = 1"):
        logs.write_event_log(events.where(run), str(tmp_path / "log"))
    assert len(list((tmp_path / "log").rglob("part-*.txt"))) <= 2 * 4
    good, bad = logs.read_event_log(spark, str(tmp_path / "log"))
    assert sorted(map(tuple, good.collect()), key=str) == sorted(rows, key=str) and bad.count() == 0
    assert {r.analysis_id for r in spark.read.json(str(tmp_path / "log"), recursiveFileLookup=True).select("analysis_id").collect()} == {r[0] for r in rows}
    logs.write_lines(events.where("seq < 2").withColumn("value", F.when(F.col("seq") == 0, F.substr(logs.line_of("seq"), F.lit(1), F.length(logs.line_of("seq")) - 3)).otherwise(logs.line_of("type"))), str(tmp_path / "cut"))
    good, bad = logs.read_event_log(spark, str(tmp_path / "cut"))
    assert {(r.analysis_id, r.seq) for r in good.collect()} == {(r[0], 1) for r in rows}
    assert bad.where("error = 'not JSON' and line_no = 1").count() == 60


def test_cases_round_trip(spark, tmp_path):
    logs.save_cases(spark.createDataFrame([(1, 0.5, None), (2, None, 1)], "case_id long, likelihood double, label int"), str(tmp_path / "c"))
    assert {tuple(r) for r in logs.load_cases(spark, str(tmp_path / "c")).collect()} == {(1, 0.5, None), (2, None, 1)}


def test_scorer(spark):
    claims = spark.createDataFrame([(1, 1), (1, 2)], "document_id int, claim_id int")
    scorers.register_scorer("flat", lambda c: c.withColumns({"dimension": F.lit("clarity"), "score": F.lit(1.7), "confidence": F.lit(0.5)}))
    assert {(r.claim_id, r.score) for r in scorers.score_with("flat", claims).collect()} == {(1, 1.0), (2, 1.0)}


def test_groups_of_types(spark):
    rows = defaultdict(int)
    for t in ("a", "b", "a"):
        rows[t] += 1
    df = spark.createDataFrame([(1, i, i, t) for i, t in enumerate("aba")], "analysis_id int, seq int, t_ms int, type string")
    assert dict(ev.log_catalogue(df).first().types) == dict(rows)


def test_default_lexicons(spark):
    text = "We aim to cut emissions by 2030.\nOur green packaging is certified and may help customers.\nIt rained."
    claims = mi.extract_quantities(mi.mine_claims(spark.createDataFrame([(1, text)], "doc_id int, text string")))
    assert [(r.type, r.timeframe) for r in claims.orderBy("start").collect()] == [("commitment", "2030"), ("certification", None)]
    marks = {(r.kind, text[r.start : r.end]) for r in mi.mine_signals(claims).collect()}
    assert {("vague_term", "green"), ("hedge", "may"), ("weak_verb", "help")} <= marks


def test_nearest_passage(spark):
    docs = spark.createDataFrame([(1, "Water use fell. Clean water and waste water matter.\nNothing else."), (2, "Of the sea."), (3, None)], "doc_id int, text string")
    topics = spark.createDataFrame([("water", "waste water"), ("water", "water rights"), ("water", "spills"), ("odd", "of the"), ("odd", "zzz"), ("odd", "yyy")], "topic string, term string")
    got = {(r.doc_id, r.topic): (round(r.score, 6), r.nearest) for r in mi.mine_omissions(docs, topics).collect()}
    assert got[1, "water"] == (0.7, "Clean water and waste water matter.") and got[2, "odd"] == (0.56, None) and got[2, "water"] == (0.7, None) and got[3, "odd"] == (0.7, None)


def test_emit_and_until_terminal(spark, tmp_path):
    from auditgrain.streaming import live

    rows = [(1, 0, "a"), (1, 1, "analysis.completed"), (1, 2, "late"), (2, 0, "a")]
    for k in (0, 1):
        spark.createDataFrame([r for r in rows if r[1] == 2 if k] or [r for r in rows if r[1] < 2], "analysis_id long, seq long, type string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    s = live.tail_log(spark, str(tmp_path / "in"), "analysis_id long, seq long, type string", maxFilesPerTrigger=1, latestFirst="false")
    seen = []
    live.emit(live.until_terminal(s), lambda batch, n: seen.extend((r.analysis_id, r.seq) for r in batch.collect()), checkpointLocation=str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [(1, 0), (1, 1), (2, 0)]
