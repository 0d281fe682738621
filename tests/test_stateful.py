"""Streams with state: after every batch what SQL says of all events so far; restarts, repeated batches and silence."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from auditgrain.operators import summary as su
from auditgrain.streaming import stateful as st

EVENT = "analysis_id long, seq long, type string, entity_id long, dimension string, final boolean, payload string"


@pytest.fixture(autouse=True)
def one_partition(spark):
    """Every task of such a query starts Python workers of its own."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def write(path, n, rows):
    path.mkdir(exist_ok=True)
    (path / f"{n}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))


def event(seq, kind, entity=None, **more):
    return {"analysis_id": more.pop("a", 1), "seq": seq, "type": kind, "entity_id": entity, "payload": f"p{seq}", **more}


def folded(events):
    out = {}
    for e in sorted({(e["analysis_id"], e["seq"]): e for e in events}.values(), key=lambda e: e["seq"]):
        part = str(e["seq"]) if e["type"] == "argument.made" else e.get("dimension") or "" if e["type"] == "dimension.scored" else ""
        key = (e["analysis_id"], e["type"], -1 if e["entity_id"] is None else e["entity_id"], part)
        out[key] = (e["seq"], e["payload"], e["type"] == "summary.updated" and not e.get("final", False))
    return out


def test_live_fold_after_every_batch(spark, tmp_path):
    """Scores by dimension, arguments all, late and repeated events, a provisional and a final summary; each batch a start of its own."""
    batches = [
        [event(1, "claim.extracted", 1), event(2, "dimension.scored", 1, dimension="clarity"), event(4, "argument.made", 1), event(5, "summary.updated")],
        [event(3, "dimension.scored", 1, dimension="support"), event(2, "dimension.scored", 1, dimension="clarity"), event(10, "argument.made", 1), event(4, "argument.made", 1), event(7, "summary.updated", final=True)],
        [event(9, "dimension.scored", 1, dimension="clarity"), event(8, "dimension.scored", 1, dimension="clarity"), event(6, "summary.updated"), event(1, "summary.updated", a=2)],
    ]
    seen, changes = [], f"{tmp_path}/changes"
    for n, rows in enumerate(batches):
        write(tmp_path / "in", n, rows)
        seen += rows
        with st.state_store(spark):  # the state comes back from the checkpoint
            s = spark.readStream.schema(EVENT).json(f"{tmp_path}/in")
            q = st.live_fold(s).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True)
            q.foreachBatch(lambda df, _: df.write.mode("append").parquet(changes)).start().awaitTermination()
        got = {(r.analysis_id, r.type, r.entity_id, r.part): (r.seq, r.payload, r.provisional) for r in st.merge_changes(spark.read.parquet(changes)).collect()}
        assert got == folded(seen)
        if n < 2:
            assert got[1, "summary.updated", -1, ""][2] == (n == 0)


def test_live_fold_calls_no_python_for_a_key(spark, tmp_path):
    """A call for each key was what the fold spent its time on."""
    write(tmp_path / "in", 0, [event(1, "claim.extracted", 1)])
    plan = st.live_fold(spark.readStream.schema(EVENT).json(f"{tmp_path}/in"))._jdf.queryExecution().toString()
    assert "Aggregate" in plan and "Pandas" not in plan and "Python" not in plan


def test_silent_stream_fails_once(spark, tmp_path):
    """No later event at all: analyses without an end fail once, also when the query has been started again."""
    write(tmp_path / "in", 0, [event(1, "x"), event(2, "x"), event(1, "x", a=2), event(2, "analysis.completed", a=2), event(1, "x", a=3)])

    def run():
        with st.state_store(spark):
            s = spark.readStream.schema(EVENT).json(f"{tmp_path}/in")
            q = st.silent(s, 2.0).writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(processingTime="300 milliseconds")
            st.run_until_quiet(q.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{tmp_path}/out")).start(), 2.0)
        return sorted((r.analysis_id, r.seq) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [(1, 2), (3, 1)]
    write(tmp_path / "in", 1, [event(3, "x"), event(7, "x", a=4)])
    assert run() == [(1, 2), (3, 1), (4, 7)]


def score(seq, doc, target, profile, value, confidence=0.8, prominence=0.6):
    return {"document_id": doc, "target": target, "profile": profile, "seq": seq, "score": value, "confidence": confidence, "prominence": prominence}


SCORE = "document_id long, target string, profile string, seq long, score double, confidence double, prominence double"


def test_header_from_deltas(spark, tmp_path):
    """Equal to the whole table's header after every batch, with a score replaced, all-zero scores, and again after a repeated batch."""
    batches = [
        [score(1, 1, "1", "clarity", 0.7), score(2, 1, "2", "clarity", 0.2, 0.5, 1.0), score(3, 1, "1", "headline", 0.7), score(4, 2, "1", "clarity", 0.0)],
        [score(5, 1, "3", "clarity", 0.9), score(6, 1, "1", "clarity", 0.1), score(7, 2, "O1", "completeness", 0.6, 0.5, None)],
        [score(8, 2, "1", "clarity", 0.4), score(6, 1, "1", "clarity", 0.1), score(5, 1, "1", "clarity", 0.99)],
    ]
    folder, rows, kept = f"{tmp_path}/deltas", [], []
    put = st.write_deltas(folder)

    def sink(df, n):
        df = df.persist()
        kept.append((pd.DataFrame(df.collect(), columns=df.columns), n))
        put(df, n)

    for n, batch in enumerate(batches):
        write(tmp_path / "in", n, batch)
        rows += batch
        with st.state_store(spark):
            s = st.header_deltas(spark.readStream.schema(SCORE).json(f"{tmp_path}/in"))
            s.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
        last = {}
        for r in sorted(rows, key=lambda r: r["seq"]):
            last[r["document_id"], r["target"], r["profile"]] = r
        table = spark.createDataFrame([(r["document_id"], r["profile"], r["score"], r["confidence"], r["prominence"]) for r in last.values()], "document_id long, profile string, score double, confidence double, prominence double")
        want = {(r.document_id, r.profile): (r.score, r.confidence, r.n_rows) for r in su.lehmer(table, ["document_id", "profile"]).collect()}
        read = lambda df: {(r.document_id, r.profile): (r.score, r.confidence, r.n_rows) for r in df.collect()}
        assert read(st.header_from_deltas(spark, folder)) == want
        again = spark.createDataFrame(kept[-1][0].values.tolist(), st._SUMS) if len(kept[-1][0]) else None
        if again is not None:
            put(again, kept[-1][1])  # delivered twice
        assert read(st.header_from_deltas(spark, folder)) == want
    assert read(st.compact_deltas(spark, folder, f"{tmp_path}/compact", 1)) == want


def test_header_deltas_of_many_documents_in_a_page(spark, tmp_path):
    """Documents share a page of the state, in two batches with scores given again, late, and repeated; ids beyond 2^53 and a null id stay apart."""
    doc = lambda i: None if i == 7 else i if i % 2 else 2**53 + i
    first = [score(2, doc(i), str(k), "clarity", (i * 7 + k) % 10 / 10, 0.5, None if k == 1 else 0.6) for i in range(150) for k in range(2)]
    second = [score(3 if i % 3 else 1, doc(i), "0", "clarity", (i + 3) % 10 / 10) for i in range(150)] + first[:40]
    folder, rows = f"{tmp_path}/deltas", {}
    for n, batch in enumerate((first, second)):
        write(tmp_path / "in", n, batch)
        with st.state_store(spark):
            s = st.header_deltas(spark.readStream.schema(SCORE).json(f"{tmp_path}/in"), pages=2)
            s.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(st.write_deltas(folder)).start().awaitTermination()
        for r in batch:
            key = r["document_id"], r["target"]
            rows[key] = r if key not in rows or r["seq"] > rows[key]["seq"] else rows[key]
        table = spark.createDataFrame([(r["document_id"], r["profile"], r["score"], r["confidence"], r["prominence"]) for r in rows.values()], "document_id long, profile string, score double, confidence double, prominence double")
        read = lambda df: {(r.document_id, r.profile): (r.score, r.confidence, r.n_rows) for r in df.collect()}
        assert read(st.header_from_deltas(spark, folder)) == read(su.lehmer(table, ["document_id", "profile"]))
