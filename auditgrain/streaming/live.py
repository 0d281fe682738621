"""The event log as a stream; every operator gives what its batch twin gives on the same events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.eventlog import TERMINAL

EVENT = "analysis_id bigint, seq bigint, t_ms bigint, type string, entity_id bigint, payload string, ts timestamp"


def tail_log(spark: SparkSession, path: str, schema: str = EVENT, fmt: str = "json", after: int | None = None, **options) -> DataFrame:
    """Events of log files as they arrive, past the cursor ``after``; the checkpoint keeps the place."""
    s = spark.readStream.schema(schema).options(**options).format(fmt).load(path)
    return s if after is None else s.where(F.col("seq") > after)


def dedupe_stream(s: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Redelivered events (same analysis and seq) are dropped within the watermark."""
    return s.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["analysis_id", "seq"])


def fold_stream(s: DataFrame) -> DataFrame:
    """Last state of every entity, kept current."""
    return s.groupBy("analysis_id", "type", "entity_id").agg(F.max("seq").alias("seq"), F.max_by("payload", "seq").alias("payload"))


def status_stream(s: DataFrame, completed: str = TERMINAL[0], failed: str = TERMINAL[1]) -> DataFrame:
    g = s.groupBy("analysis_id").agg(F.max_by("type", "seq").alias("last"), F.max("seq").alias("seq"))
    return g.select("analysis_id", "seq", F.when(F.col("last") == completed, "completed").when(F.col("last") == failed, "failed").otherwise("running").alias("status"))


def progress_stream(s: DataFrame) -> DataFrame:
    """Stages with when they started and whether they are done."""
    g = s.where(F.col("type").isin("stage.started", "stage.completed")).groupBy("analysis_id", F.col("entity_id").alias("stage"))
    return g.agg(F.min(F.when(F.col("type") == "stage.started", F.col("seq"))).alias("started"), F.max_by("type", "seq").alias("last")).select("analysis_id", "stage", "started", F.when(F.col("last") == "stage.completed", "done").otherwise("running").alias("state"))


def type_counts(s: DataFrame) -> DataFrame:
    return s.groupBy("analysis_id", "type").agg(F.count(F.lit(1)).alias("n"))


def until_terminal(s: DataFrame, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Events up to the first terminal one of their analysis, that included; later ones are dropped.  State is one flag an analysis."""
    names = s.columns

    def cut(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        if state.exists:
            yield rows.iloc[:0][names]
            return
        ends = rows["type"].isin(terminal).to_numpy().nonzero()[0]
        if len(ends):
            state.update((True,))
            rows = rows.iloc[: ends[0] + 1]
        yield rows[names]

    return s.groupBy("analysis_id").applyInPandasWithState(cut, s.schema, "ended boolean", "append", GroupStateTimeout.NoTimeout)


def emit(s: DataFrame, fn, **options):
    """A query that hands every batch's events, a DataFrame and the batch's number, to ``fn``."""
    return s.writeStream.options(**options).foreachBatch(fn)


def stalled(s: DataFrame, timeout: str = "10 minutes", delay: str = "1 minute", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Bursts of an analysis' events that a silence of ``timeout`` ends without a terminal event."""
    g = s.withWatermark("ts", delay).groupBy("analysis_id", F.session_window("ts", timeout).alias("w"))
    return g.agg(F.max("seq").alias("seq"), F.max(F.col("type").isin(*terminal)).alias("ended")).where("not ended").select("analysis_id", F.col("w.end").alias("since"), "seq")


def validate_stream(s: DataFrame, started: str | None = None, terminal: tuple[str, ...] = ()) -> DataFrame:
    """(analysis_id, seq, rule) of events whose seq does not follow the last one's, or whose t_ms goes back; with
    ``started`` and ``terminal`` also of those that start again, come before the start or after the end.

    State is two numbers and a flag for each analysis.  These are the rejects; what is admitted is the stream without them."""

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, t, ended = state.get if state.exists else (None, None, False)
        rows = []
        for e in pd.concat(list(frames)).sort_values("seq").itertuples():
            if last is not None and e.seq != last + 1:
                rows.append((key[0], e.seq, "seq"))
            if t is not None and e.t_ms < t:
                rows.append((key[0], e.seq, "t_ms"))
            if started is not None and (e.type == started) != (last is None):
                rows.append((key[0], e.seq, "not_started" if last is None else "started_again"))
            if ended:
                rows.append((key[0], e.seq, "after_terminal"))
            last, t, ended = int(e.seq), int(e.t_ms), ended or e.type in terminal
        state.update((last, t, ended))
        yield pd.DataFrame(rows, columns=["analysis_id", "seq", "rule"])

    return s.groupBy("analysis_id").applyInPandasWithState(check, "analysis_id long, seq long, rule string", "last long, t long, ended boolean", "append", GroupStateTimeout.NoTimeout)


def run_once(s: DataFrame, mode: str, folder: str) -> DataFrame:
    """Read all that is there, write what each batch gives under ``folder``, and read the result.

    In complete mode the last batch is the result; in append mode all of them are."""
    spark, out = s.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{out}/data")

    s.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{out}/data")


def live_summary(s: DataFrame, recompute, sink, key: str = "analysis_id"):
    """A query that, for every batch, recomputes the headers of the analyses it touches.

    ``recompute`` maps their keys (a DataFrame) to header rows; ``sink`` takes those rows and the batch number."""

    def step(batch: DataFrame, number: int) -> None:
        sink(recompute(batch.select(key).distinct()), number)

    return s.writeStream.foreachBatch(step)
