"""The event log: checks, folds, progress and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .segments import BLOCK, running

TERMINAL = ("analysis.completed", "analysis.failed")


def envelope_violations(events: DataFrame, started: str = "analysis.started", terminal: tuple[str, ...] = TERMINAL, block: int = BLOCK) -> DataFrame:
    """(analysis_id, seq, rule): seq has a gap or repeat, t_ms goes back, started isn't first only, terminal isn't last only (or never comes).

    An analysis of more than ``block`` events is checked in blocks."""
    seen = running(events, ["analysis_id"], ["seq"], {"__ps": ("lag", F.col("seq")), "__pt": ("lag", F.col("t_ms")), "__ns": ("lead", F.col("seq"))}, block)
    prev_seq, prev_t, after = F.col("__ps"), F.col("__pt"), F.col("__ns")
    rules = F.array_compact(F.array(
        F.when(prev_seq.isNotNull() & (F.col("seq") != prev_seq + 1), "seq"), F.when(F.col("t_ms") < prev_t, "t_ms"),
        F.when((F.col("type") == started) & prev_seq.isNotNull(), "started_again"), F.when((F.col("type") != started) & prev_seq.isNull(), "not_started"),
        F.when(F.col("type").isin(*terminal) & after.isNotNull(), "after_terminal"), F.when(~F.col("type").isin(*terminal) & after.isNull(), "not_terminated"),
    ))
    return seen.withColumn("__r", rules).select("analysis_id", "seq", F.explode("__r").alias("rule"))


def clamp_time(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Events stamped earlier than one before them take that one's time; an analysis of more than ``block`` events goes in blocks."""
    got = running(events, ["analysis_id"], ["seq"], {"__t": ("max", F.col("t_ms"))}, block)
    return got.withColumn("t_ms", F.col("__t")).drop("__t")


def log_catalogue(events: DataFrame, rejects: DataFrame | None = None) -> DataFrame:
    """(analysis_id, n_events, duration_ms, types map, error) of every log; logs with rejected lines carry the first error."""
    per = events.groupBy("analysis_id", "type").agg(F.count(F.lit(1)).alias("n"), F.max("t_ms").alias("t"))
    out = per.groupBy("analysis_id").agg(F.sum("n").alias("n_events"), F.max("t").alias("duration_ms"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("types"))
    if rejects is None:
        return out.withColumn("error", F.lit(None).cast("string"))
    bad = rejects.groupBy("analysis_id").agg(F.min_by("error", "line_no").alias("error"))
    return out.join(bad, "analysis_id", "full")


def fold_arguments(events: DataFrame, kind: str = "argument.made", key: str = "entity_id") -> DataFrame:
    """(analysis_id, key, arguments array<struct<seq, payload>>): a claim's arguments, all of them, in order."""
    return events.where(F.col("type") == kind).groupBy("analysis_id", key).agg(F.array_sort(F.collect_list(F.struct("seq", "payload"))).alias("arguments"))


def fold_scores(events: DataFrame, kind: str = "dimension.scored", key: str = "entity_id", dimension: str = "dimension") -> DataFrame:
    """(analysis_id, key, dimension, seq, payload): the last score of each claim in each dimension."""
    return events.where(F.col("type") == kind).groupBy("analysis_id", key, dimension).agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def fold_summary(events: DataFrame, kind: str = "summary.updated") -> DataFrame:
    """(analysis_id, seq, payload): the latest summary."""
    return events.where(F.col("type") == kind).groupBy("analysis_id").agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def fold_log(events: DataFrame, key: str = "entity_id") -> DataFrame:
    """Last state of every entity: (analysis_id, type, key, seq, payload)."""
    return events.groupBy("analysis_id", "type", key).agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def stage_spans(events: DataFrame, start: str = "stage.started", end: str = "stage.completed", stage: str = "entity_id", block: int = BLOCK) -> DataFrame:
    """(analysis_id, stage, start_seq, end_seq): from each start of a stage to its next completion (null: still open)."""
    marks = events.where(F.col("type").isin(start, end))
    marks = running(marks, ["analysis_id", stage], ["seq"], {"done": ("next", F.when(F.col("type") == end, F.col("seq")))}, block)
    return marks.where(F.col("type") == start).select("analysis_id", F.col(stage).alias("stage"), F.col("seq").alias("start_seq"), F.col("done").alias("end_seq"))


def open_stages(events: DataFrame, start: str = "stage.started", end: str = "stage.completed", stage: str = "entity_id", block: int = BLOCK) -> DataFrame:
    """events with ``open_before``: how many stages were open just before each, from one scan in the order of seq.

    A start of a stage opens it, a completion closes it; a repeated start or a stray completion changes nothing."""
    kind = F.when(F.col("type").isin(start, end), F.col("type"))
    marks = running(events.where(kind.isNotNull()), ["analysis_id", stage], ["seq"], {"__was": ("lag", F.col("type"))}, block)
    was_open = F.coalesce(F.col("__was") == start, F.lit(False))
    change = F.when((F.col("type") == start) & ~was_open, 1).when((F.col("type") == end) & was_open, -1).otherwise(0)
    steps = marks.withColumn("__step", change).drop("__was")
    rest = events.where(kind.isNull()).withColumn("__step", F.lit(0))
    counted = running(steps.unionByName(rest), ["analysis_id"], ["seq"], {"open_before": ("sum", F.col("__step"))}, block)
    return counted.drop("__step")


def events_in_stage(events: DataFrame, spans: DataFrame, owners: DataFrame) -> DataFrame:
    """Domain events with ``inside``: whether one of their owner stages is open then.  owners: type, stage."""
    owned = events.join(owners, "type")
    hit = owned.join(spans, ["analysis_id", "stage"], "left").withColumn("in", F.coalesce((F.col("seq") > F.col("start_seq")) & (F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq"))), F.lit(False)))
    return hit.groupBy("analysis_id", "seq", "type").agg(F.max("in").alias("inside"))


def use_before_definition(uses: DataFrame, definitions: DataFrame) -> DataFrame:
    """uses (analysis_id, seq, ref) whose ref is defined (analysis_id, seq, id) only later, or never."""
    first = definitions.groupBy("analysis_id", F.col("id").alias("ref")).agg(F.min("seq").alias("defined"))
    return uses.join(first, ["analysis_id", "ref"], "left").where("defined is null or defined >= seq").select("analysis_id", "seq", "ref", "defined")


def stage_progress(events: DataFrame, stage: str = "entity_id") -> DataFrame:
    """(analysis_id, stage, started, state, place): stages in the order they started, running or done."""
    g = events.where(F.col("type").isin("stage.started", "stage.completed")).groupBy("analysis_id", F.col(stage).alias("stage")).agg(
        F.min(F.when(F.col("type") == "stage.started", F.col("seq"))).alias("started"), F.max_by("type", "seq").alias("last"))
    out = g.where("started is not null").withColumn("state", F.when(F.col("last") == "stage.completed", "done").otherwise("running")).drop("last")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("analysis_id").orderBy("started", "stage")))


def status(events: DataFrame, completed: str = TERMINAL[0], failed: str = TERMINAL[1]) -> DataFrame:
    last = events.groupBy("analysis_id").agg(F.max_by("type", "seq").alias("last"), F.max("seq").alias("seq"))
    return last.select("analysis_id", "seq", F.when(F.col("last") == completed, "completed").when(F.col("last") == failed, "failed").otherwise("running").alias("status"))


def export_log(events: DataFrame, analysis_id) -> DataFrame:
    """One analysis as JSON lines in order."""
    return events.where(F.col("analysis_id") == analysis_id).orderBy("seq").select("seq", F.to_json(F.struct("seq", "t_ms", "type", "payload")).alias("line"))


def spread(captures: DataFrame, key: str, n: int = 3, before: DataFrame | None = None, min_age_days: int = 30) -> DataFrame:
    """For each key the captures nearest to ``n`` even times between its first and last, distinct, oldest first.

    Captures less than ``min_age_days`` before the key's ``before`` date go, unless none would be left."""
    rows = captures
    if before is not None:
        rows = rows.join(before, key, "left").withColumn("__old", F.coalesce(F.datediff("before", "stamp") >= min_age_days, F.lit(True)))
        rows = rows.withColumn("__any", F.max("__old").over(Window.partitionBy(key))).where(F.col("__old") | ~F.col("__any")).drop("__old", "__any", "before")
    s = F.unix_micros(F.col("stamp").cast("timestamp"))
    ends = rows.groupBy(key).agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    marks = ends.select(key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.lit(max(n - 1, 1)))).alias("mark"))
    near = rows.join(marks, key).groupBy(key, "mark").agg(F.min_by("stamp", F.struct(F.abs(s - F.col("mark")), F.col("stamp"))).alias("stamp"))
    return near.select(key, "stamp").distinct()
