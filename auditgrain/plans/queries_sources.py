"""Queries of file sources and sinks, streams and SQL use: the given tables are written out in the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import summary as su
from ..scratch import shared_folder
from ..sources import logs
from ..streaming import live, stateful
from .queries_audit import verdicts
from .queries_events import _EV, _log, _LOG, _once, _stream
from .registry import query
from .sqluse import lehmer_sql, register_functions, register_views


def _folder(t, name: str) -> str:
    return f"{shared_folder(t._spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY seq) AS line_no FROM {_LOG})
SELECT CAST(analysis_id AS VARCHAR) AS analysis_id, CASE WHEN entity_id % 9 = 4 OR entity_id % 11 = 5 THEN 'reject' ELSE 'event' END AS what, CASE WHEN entity_id % 9 = 4 OR entity_id % 11 = 5 THEN line_no WHEN entity_id % 6 = 1 THEN line_no - 1 ELSE seq END AS n,
 CASE WHEN entity_id % 9 = 4 THEN 'not JSON' WHEN entity_id % 11 = 5 THEN 'no type' ELSE type END AS detail FROM l""")
def s1_read_event_log(t):
    """Logs with lines that are broken, lack a type or a seq, read back: events, and rejects with their line numbers."""
    e = F.col("entity_id")
    whole = logs.line_of("seq", "t_ms", "type", "payload")
    line = F.when(e % 9 == 4, F.substr(whole, F.lit(1), F.length(whole) - 3)).when(e % 11 == 5, logs.line_of("seq", "t_ms")).when(e % 6 == 1, logs.line_of("t_ms", "type", "payload")).otherwise(whole)
    path = _folder(t, "lines")
    logs.write_lines(_log(t).select("analysis_id", "seq", line.alias("value")), path)
    good, bad = logs.read_event_log(t._spark, path)
    return good.select("analysis_id", F.lit("event").alias("what"), F.col("seq").alias("n"), F.col("type").alias("detail")).unionByName(
        bad.select("analysis_id", F.lit("reject").alias("what"), F.col("line_no").cast("long").alias("n"), F.col("error").alias("detail")))


@query(f"SELECT CAST(analysis_id AS VARCHAR) AS analysis_id, seq, t_ms, type, payload FROM {_LOG}")
def s7_write_event_log(t):
    """Two runs of each analysis appended, and all read back."""
    path = _folder(t, "log")
    rows = _log(t).select("analysis_id", "seq", "t_ms", "type", "payload")
    for part in ("seq % 2 = 0", "seq % 2 = 1"):
        logs.write_event_log(rows.where(part), path)
    return logs.read_event_log(t._spark, path)[0]


@query("""SELECT document_id, n_claims FROM (SELECT document_id, count(*) AS n_claims FROM v_claims GROUP BY 1) WHERE document_id % 10 <> 3 AND document_id % 7 <> 5""")
def s2_read_analyses(t):
    """Folded analyses as nested JSON; those without a summary or document are skipped."""
    d = F.col("document_id")
    folded = t.v_claims.groupBy("document_id").agg(F.collect_list(F.struct("claim_id", "type")).alias("claims"))
    doc = F.when(d % 7 != 5, F.struct(d.alias("id")))
    path = _folder(t, "analyses")
    folded.select(F.to_json(F.struct(doc.alias("document"), "claims", F.when(d % 10 != 3, F.struct(F.size("claims").alias("claim_count"))).alias("summary"))).alias("value")).write.text(path)
    got = logs.read_analyses(t._spark, path, "document struct<id: bigint>, claims array<struct<claim_id: bigint, type: string>>, summary struct<claim_count: int>", lines=True)
    return got.select(F.col("document.id").alias("document_id"), F.size("claims").cast("long").alias("n_claims"))


@query("SELECT 'entry' AS what, CAST(p_partkey AS VARCHAR) AS entry_id, 1 AS n FROM part WHERE p_partkey % 50 <> 7 UNION ALL SELECT 'entry', '7', 1 FROM part WHERE p_partkey % 50 = 7 UNION ALL SELECT 'repeated', '7', count(*) FROM part WHERE p_partkey % 50 = 7 OR p_partkey = 7 HAVING count(*) > 1")
def s3_read_store(t):
    """A store of entries, some under one id: the entries, and the ids that occur again."""
    k = F.col("p_partkey")
    path = _folder(t, "store")
    t.part.select(F.to_json(F.struct(F.when(k % 50 == 7, "7").otherwise(k.cast("string")).alias("entry_id"), F.col("p_name").alias("name"))).alias("value")).write.text(path)
    rows, twice = logs.read_store(t._spark, path, "entry_id string, name string", lines=True)
    return rows.select(F.lit("entry").alias("what"), "entry_id", F.lit(1).cast("long").alias("n")).unionByName(twice.select(F.lit("repeated").alias("what"), "entry_id", "n"))


@query(f"SELECT seq, '{{\"seq\":' || seq || ',\"t_ms\":' || t_ms || ',\"type\":\"' || type || '\"' || coalesce(',\"payload\":' || to_json(payload), '') || '}}' AS line FROM {_LOG} WHERE analysis_id = (SELECT min(analysis_id) FROM v_log)")
def s8_export_log(t):
    """One analysis as JSON lines in the order of seq."""
    from ..operators.eventlog import export_log

    first = t.v_log.agg(F.min("analysis_id").alias("a")).first()["a"]
    return export_log(_log(t), first)


@query("SELECT case_id, likelihood, label FROM v_cases")
def s11_save_cases(t):
    """Scored cases written and read again, so that thresholds can move without scoring anew."""
    path = _folder(t, "cases")
    logs.save_cases(t.v_cases.select("case_id", "likelihood", F.col("label").cast("int").alias("label")), path)
    return logs.load_cases(t._spark, path)


@query(f"""WITH e AS (SELECT *, min(CASE WHEN type = 'stage.completed' THEN seq END) OVER (PARTITION BY analysis_id) AS done FROM {_EV}) SELECT analysis_id, seq FROM e WHERE (done IS NULL OR seq <= done) AND seq > 100""")
def x1_tail_until_terminal(t):
    """The log past a cursor, each analysis up to its terminal event."""
    s = live.until_terminal(_stream(t).select("analysis_id", "seq", "type"), ("stage.completed",))
    return _once(t, s, "append").where("seq > 100").select("analysis_id", "seq")


@query("""WITH e AS (SELECT user_id AS analysis_id, event_id AS seq, ts, event_type = 'purchase' AS done FROM events), g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY analysis_id ORDER BY ts, seq) + INTERVAL 12 HOUR THEN 1 ELSE 0 END AS gap FROM e),
s AS (SELECT *, sum(gap) OVER (PARTITION BY analysis_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT analysis_id, max(seq) AS seq FROM s GROUP BY analysis_id, k HAVING NOT bool_or(done) AND max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def x7_stalled(t):
    """Analyses that fell silent for twelve hours without a terminal event."""
    return _once(t, live.stalled(_stream(t), "12 hours", "1 hour", ("stage.completed",)), "append").select("analysis_id", "seq")


@query(f"SELECT analysis_id, count(*) AS n_events, max(seq) AS seq FROM {_EV} GROUP BY 1")
def x8_live_summary(t):
    """Headers of the analyses that each batch touches, recomputed from the whole log; the latest of each."""
    out = _folder(t, "headers")
    whole = t.events.select(F.col("user_id").alias("analysis_id"), F.col("event_id").alias("seq"))

    def recompute(keys):
        return whole.join(keys, "analysis_id", "left_semi").groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("seq").alias("seq"))

    def sink(rows, number):
        rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/data")

    live.live_summary(_stream(t), recompute, sink).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = t._spark.read.schema("analysis_id long, n_events long, seq long, batch int").parquet(f"{out}/data")
    return got.groupBy("analysis_id").agg(F.max_by("n_events", "batch").alias("n_events"), F.max_by("seq", "batch").alias("seq"))


@query(f"""WITH x AS (SELECT *, lag(seq) OVER w AS ps, min(CASE WHEN type = 'stage.completed' THEN seq END) OVER (PARTITION BY analysis_id) AS done FROM {_EV} WINDOW w AS (PARTITION BY analysis_id ORDER BY seq))
SELECT analysis_id, seq, unnest(list_filter([CASE WHEN ps IS NOT NULL AND seq <> ps + 1 THEN 'seq' END, CASE WHEN ps IS NULL AND type <> 'stage.started' THEN 'not_started' END, CASE WHEN ps IS NOT NULL AND type = 'stage.started' THEN 'started_again' END, CASE WHEN seq > done THEN 'after_terminal' END], lambda x: x IS NOT NULL)) AS rule FROM x""")
def x10_validate_all(t):
    """All rules of the envelope on the stream."""
    return _once(t, live.validate_stream(_stream(t), "stage.started", ("stage.completed",)), "append")


@query(f"""WITH e AS (SELECT analysis_id, seq, CASE type WHEN 'evidence.added' THEN 'argument.made' WHEN 'claim.extracted' THEN 'summary.updated' ELSE type END AS type, entity_id, payload, seq % 3 = 0 AS final FROM {_EV}),
p AS (SELECT *, CASE WHEN type = 'argument.made' THEN seq::VARCHAR WHEN type = 'dimension.scored' THEN 'd' || seq % 4 ELSE '' END AS part FROM e)
SELECT analysis_id, type, entity_id, part, max(seq) AS seq, arg_max(payload, seq) AS payload, type = 'summary.updated' AND NOT arg_max(final, seq) AS provisional FROM p GROUP BY 1, 2, 3, 4""")
def x3_live_fold(t):
    """The folded state of all analyses from its stream of changes: scores by dimension, all arguments, summaries provisional until a final one."""
    kind = F.col("type")
    s = _stream(t).select(
        "analysis_id", "seq", F.when(kind == "evidence.added", "argument.made").when(kind == "claim.extracted", "summary.updated").otherwise(kind).alias("type"), "entity_id", "payload",
        F.concat(F.lit("d"), (F.col("seq") % 4).cast("string")).alias("dimension"), (F.col("seq") % 3 == 0).alias("final"))
    with stateful.state_store(t._spark):
        return stateful.merge_changes(_once(t, stateful.live_fold(s), "update"))


@query(f"SELECT analysis_id, max(seq) AS seq FROM {_EV} GROUP BY 1 HAVING count(*) FILTER (WHERE type = 'stage.completed' AND analysis_id % 3 = 0) = 0")
def x7_silent(t):
    """Analyses that never ended and fell silent, by the clock: no event comes after the last one."""
    out = _folder(t, "silent")
    events = _stream(t).withColumn("type", F.when(F.col("analysis_id") % 3 == 0, F.col("type")).otherwise("going on"))  # most never end
    s = stateful.silent(events, 1.0, ("stage.completed",))
    with stateful.state_store(t._spark):
        q = s.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="200 milliseconds").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{out}/data")).start()
        stateful.run_until_quiet(q, 1.0, 600.0)
    return t._spark.read.schema("analysis_id long, seq long").parquet(f"{out}/data")


@query("SELECT document_id, profile, score, confidence FROM v_header WHERE profile IN ('headline', 'completeness')")
def x8_header_deltas(t):
    """Headlines and completeness of all documents from deltas of a stream in four batches, the scores of some given twice."""
    folder = _folder(t, "deltas")
    rows = su.issue_rows(verdicts(t), t.v_omissions).withColumn("seq", F.lit(2).cast("long"))
    early = rows.where("pmod(hash(document_id, target), 5) = 0").withColumn("seq", F.lit(1).cast("long")).withColumn("score", 1 - F.col("score"))
    names = ["document_id", "target", "profile", "seq", "score", "confidence", "prominence"]
    rows.unionByName(early).select(names).repartition(4).write.parquet(f"{folder}/scores")
    s = t._spark.readStream.schema("document_id long, target string, profile string, seq long, score double, confidence double, prominence double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/scores")
    with stateful.state_store(t._spark):
        stateful.header_deltas(s).writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(stateful.write_deltas(f"{folder}/deltas")).start().awaitTermination()
    return stateful.header_from_deltas(t._spark, f"{folder}/deltas").select("document_id", "profile", "score", "confidence")


@query("SELECT document_id, profile, score FROM v_header WHERE profile IN ('clarity', 'support', 'materiality', 'consistency')")
def e6_sql_header(t):
    """The header's dimensions written in SQL on registered views, with the mean as an expression."""
    register_views(t._spark, t._dir, ("v_scores", "v_claims"))
    return t._spark.sql(f"""SELECT document_id, dimension AS profile, round(coalesce(s, 0) + 1e-9, 2) AS score FROM (
        SELECT s.document_id, s.dimension, {lehmer_sql("s.score", "greatest(c.prominence * s.confidence, 1e-6)")} AS s
        FROM v_scores s JOIN v_claims c ON c.document_id = s.document_id AND c.claim_id = s.claim_id GROUP BY s.document_id, s.dimension)""")


@query("SELECT document_id, claim_id, likelihood, category, deciding, confidence FROM v_verdicts")
def e6_sql_verdicts(t):
    """Verdicts of all claims in one SQL statement with the library's functions."""
    register_views(t._spark, t._dir, ("v_claims", "v_scores", "v_links"))
    register_functions(t._spark)
    dims = ("clarity", "support", "materiality", "consistency")
    picks = ", ".join(f"max({c}) FILTER (WHERE dimension = '{d}') AS {d}{e}" for d in dims for c, e in (("score", ""), ("confidence", "_conf")))
    both = ", ".join(dims) + ", " + ", ".join(f"{d}_conf" for d in dims)
    return t._spark.sql(f"""WITH s AS (SELECT document_id, claim_id, {picks} FROM v_scores GROUP BY ALL),
        i AS (SELECT document_id, claim_id, evidence_id, min(tier) AS tier, bool_or(relation IN ('supports', 'contradicts', 'contradicts_framing')) AS decisive, bool_or(relation = 'supports') AS sup, bool_or(relation = 'contradicts') AS con FROM v_links GROUP BY ALL),
        e AS (SELECT document_id, claim_id, count(*) AS n_items, coalesce(min(tier) FILTER (WHERE decisive), min(tier)) AS best_tier, bool_or(sup) AS supports, bool_or(con) AS contradicts FROM i GROUP BY ALL),
        w AS (SELECT c.document_id, c.claim_id, {both}, n_items, best_tier, coalesce(supports, false) AS supports, coalesce(contradicts, false) AS contradicts, audit_deciding({both}) AS deciding
              FROM v_claims c LEFT JOIN s USING (document_id, claim_id) LEFT JOIN e USING (document_id, claim_id))
        SELECT document_id, claim_id, audit_likelihood({", ".join(dims)}) AS likelihood, audit_category({both}, contradicts) AS category, deciding,
               audit_confidence(deciding, {both}, best_tier, n_items, supports, contradicts) AS confidence FROM w""")


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM documents)
SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0 ELSE round(len(list_filter(ws, lambda x: x IN ('the', 'of', 'der', 'que'))) / len(ws), 6) END AS score, least(0.9e0, 0.5e0 + len(ws) / 100e0) AS confidence FROM w""")
def e1_table_function(t):
    """A scorer called from SQL as a table function."""
    register_functions(t._spark)
    t.documents.select("doc_id", "text").createOrReplaceTempView("scored_texts")
    return t._spark.sql("SELECT doc_id, score, confidence FROM audit_score(TABLE(scored_texts), words => 'the,of,der,que')")
