"""Streams whose operators keep state of their own: the live fold, silence alarms, and headers from deltas.

The live fold keeps its state by (analysis, kind, entity, part), never by analysis alone, so that one large analysis is spread over tasks.  All of it is in the checkpoint: a query that is started again goes on where it ended."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import DEFAULT, DIMENSIONS
from ..operators.eventlog import TERMINAL
from ..operators.verdict import clamp01

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Queries started within keep their state in RocksDB, which maps, lists and timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def live_fold(s: DataFrame, arguments: str = "argument.made", scores: str = "dimension.scored", summary: str = "summary.updated") -> DataFrame:
    """Changes of the folded state (update mode): analysis_id, type, entity_id, part, seq, payload, provisional.

    s: analysis_id, seq, type, entity_id, payload, and where they are there ``dimension`` and ``final``.  Of every entity the event of
    the highest seq holds, however late others arrive; a claim's scores are held for each dimension (``part``), its arguments are all kept (``part`` is
    their seq); a summary is provisional until one with ``final`` holds.  Events that come again change nothing: analysis_id and seq tell events
    apart.  State is one row for each part, kept by Spark's own aggregation: no task calls Python for a key.  An entity whose late event
    changes nothing is given again as it is.  The table of
    the state is the row of the highest seq for each (analysis_id, type, entity_id, part): see ``merge_changes``."""
    have = s.columns
    kind = F.col("type")
    dimension = F.coalesce(F.col("dimension").cast("string"), F.lit("")) if "dimension" in have else F.lit("")
    final = F.coalesce(F.col("final"), F.lit(False)) if "final" in have else F.lit(False)
    rows = s.select(
        "analysis_id", "type", F.coalesce(F.col("entity_id").cast("long"), F.lit(-1)).alias("entity_id"),
        F.when(kind == arguments, F.col("seq").cast("string")).when(kind == scores, dimension).otherwise("").alias("part"), "seq",
        F.struct("payload", ((kind == summary) & ~final).alias("provisional")).alias("x"))
    g = rows.groupBy("analysis_id", "type", "entity_id", "part").agg(F.max("seq").alias("seq"), F.max_by("x", "seq").alias("x"))
    return g.select("analysis_id", "type", "entity_id", "part", "seq", "x.payload", "x.provisional")


def merge_changes(changes: DataFrame) -> DataFrame:
    """The state that a table of changes amounts to; changes that were written twice count once."""
    last = F.max_by(F.struct("payload", "provisional"), "seq")
    return changes.groupBy("analysis_id", "type", "entity_id", "part").agg(F.max("seq").alias("seq"), last.alias("x")).select("analysis_id", "type", "entity_id", "part", "seq", "x.payload", "x.provisional")


class _Silence(StatefulProcessor):
    """Fails an analysis once when nothing has come for the timeout and it has not ended."""

    def __init__(self, timeout_ms: int, terminal: tuple[str, ...]):
        self.timeout_ms, self.terminal = timeout_ms, terminal

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "seq long, due long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, due, ended = self.state.get() if self.state.exists() else (None, None, False)
        for part in rows:
            top = int(part["seq"].max())
            seq = top if seq is None else max(seq, top)
            ended = bool(ended or part["type"].isin(self.terminal).any())
        if due is not None:
            self.handle.deleteTimer(due)
            due = None
        if not ended:
            due = timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            self.handle.registerTimer(due)
        self.state.update((seq, due, ended))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, _, _ = self.state.get()
        self.state.update((seq, None, True))  # failed: what comes later fails it no second time
        yield pd.DataFrame([(key[0], seq)], columns=["analysis_id", "seq"])

    def close(self) -> None:
        pass


def silent(s: DataFrame, timeout_s: float = 600.0, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """(analysis_id, seq) of analyses that have sent nothing for ``timeout_s`` seconds of the clock without a terminal event; each once.

    The clock is the cluster's, not the events': a stream that falls wholly silent fires as well, at the next trigger after the
    time is up.  Give the query a trigger with an interval; a trigger that only takes what is there does not wait."""
    return s.select("analysis_id", "seq", "type").groupBy("analysis_id").transformWithStateInPandas(
        statefulProcessor=_Silence(int(timeout_s * 1000), tuple(terminal)), outputStructType="analysis_id long, seq long", outputMode="Append", timeMode="ProcessingTime")


def run_until_quiet(query: StreamingQuery, quiet_s: float, limit_s: float = 120.0) -> None:
    """Let ``query`` run until a batch that began ``quiet_s`` seconds after the last one with events has ended (at most ``limit_s``), then stop it.

    A query with timers never says that it has taken all there is, as it keeps looking at the clock."""
    began = lambda p: pd.Timestamp(p["timestamp"]).timestamp()
    end, data, seen = time.time() + limit_s, None, -1
    try:
        while time.time() < end and query.isActive:
            for p in query.recentProgress:
                if p["batchId"] <= seen:
                    continue
                seen = p["batchId"]
                if data is None or p["numInputRows"]:
                    data = began(p)
                elif began(p) > data + quiet_s:
                    return
            time.sleep(0.1)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()


_SUMS = "document_id long, profile string, share double, score_share double, confidence_share double, weight double, confidence_weight double, n long"
_ADDED = [c.split()[0] for c in _SUMS.split(", ")][2:]


#: Pages that documents are dealt to; a page's targets are one value of the state.
PAGES = 1024
_TARGET = ["unnamed", "document_id", "target", "profile"]


class _Page(StatefulProcessor):
    """What targets add to their documents' sums; a score that is given again first takes back what the old one added.

    The last score of each target of a page is held in Arrow's form and a batch is merged into it as a whole: one call of the state for a page."""

    def __init__(self, power: float, default_prominence: float):
        self.power, self.default = power, default_prominence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.page = handle.getValueState("page", "targets binary")

    def _adds(self, rows: pd.DataFrame) -> pd.DataFrame:
        score, confidence = rows["score"], rows["confidence"]
        w = (rows["prominence"] * confidence).clip(lower=1e-6)
        share = (w * score.clip(lower=0.0) ** (self.power - 1)).where(score > 0, 0.0)
        sums = {"share": share, "score_share": score * share, "confidence_share": confidence * share, "weight": w, "confidence_weight": confidence * w}
        return rows[["unnamed", "document_id", "profile"]].assign(**sums, n=1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[[*_TARGET, "seq", "score", "confidence", "prominence"]]
        # of a target's rows the highest seq, and the first one of these
        new = new.sort_values("seq", kind="stable", ascending=False).drop_duplicates(_TARGET)
        new["prominence"] = new["prominence"].astype("float64").fillna(self.default)
        old = pa.ipc.open_stream(self.page.get()[0]).read_pandas() if self.page.exists() else new.iloc[:0]
        at = pd.MultiIndex.from_frame(old[_TARGET]).get_indexer(pd.MultiIndex.from_frame(new[_TARGET])) if len(old) else np.full(len(new), -1)
        later = at < 0
        later[~later] = new["seq"].to_numpy()[~later] > old["seq"].to_numpy()[at[~later]]
        new, gone = new[later], at[later & (at >= 0)]
        back = self._adds(old.iloc[gone])
        back[_ADDED] *= -1
        keep = np.ones(len(old), bool)
        keep[gone] = False
        page = pa.RecordBatch.from_pandas(pd.concat([old[keep], new]) if len(old) else new, preserve_index=False)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, page.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
            writer.write_batch(page)
        if len(new):
            self.page.update((out.getvalue().to_pybytes(),))
        yield pd.concat([back, self._adds(new)]).groupby(["unnamed", "document_id", "profile"], dropna=False, as_index=False)[_ADDED].sum()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter([])

    def close(self) -> None:
        pass


def header_deltas(s: DataFrame, power: float = DEFAULT.power, default_prominence: float = DEFAULT.default_prominence, slices: int = 1, pages: int = PAGES) -> DataFrame:
    """What each batch adds to the sums of its documents' headers: Lehmer sums are additive, so headers need no second look at older events.

    s: document_id, target, profile, seq, score, confidence, prominence; ``target`` is a claim or an omission, ``profile`` a dimension, ``headline``
    or ``completeness``.  A score of the same target and profile with a higher seq replaces the one before.  State is kept by page, to which documents are
    dealt (``pages``, fixed for a checkpoint); documents of very many claims are dealt to ``slices`` pages by their targets."""
    number = lambda c: F.col(c).cast("double").alias(c)
    rows = s.where("score is not null and confidence is not null").select(
        F.col("document_id").isNull().alias("unnamed"), F.coalesce(F.col("document_id").cast("long"), F.lit(0)).alias("document_id"),  # a null would make the column doubles
        F.col("target").cast("string").alias("target"), "profile", F.col("seq").cast("long").alias("seq"), number("score"), number("confidence"), number("prominence"))
    page = F.pmod(F.xxhash64("document_id", F.pmod(F.xxhash64("target"), F.lit(slices))), F.lit(pages))
    got = rows.withColumn("page", page).groupBy("page").transformWithStateInPandas(
        statefulProcessor=_Page(power, default_prominence), outputStructType="unnamed boolean, " + _SUMS, outputMode="Append", timeMode="None")
    return got.withColumn("document_id", F.when(~F.col("unnamed"), F.col("document_id"))).drop("unnamed")


def write_deltas(folder: str):
    """A sink for foreachBatch: a batch's deltas, summed by document and profile, under its number; a batch that comes again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        g = batch.groupBy("document_id", "profile").agg(*(F.sum(c).alias(c) for c in _ADDED))
        g.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return put


def header_from_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, profile, score, confidence, n_rows) from all deltas written so far."""
    d = spark.read.schema(_SUMS + ", batch long").option("basePath", folder).parquet(folder)
    g = d.groupBy("document_id", "profile").agg(*(F.sum(c).alias(c) for c in _ADDED)).where("n > 0")
    live = F.col("share") > 1e-12  # what was taken back leaves rounding
    score = F.when(live, F.col("score_share") / F.col("share")).otherwise(0.0)
    confidence = F.when(live, F.col("confidence_share") / F.col("share")).otherwise(F.col("confidence_weight") / F.col("weight"))
    return g.select("document_id", "profile", clamp01(score).alias("score"), clamp01(confidence).alias("confidence"), F.col("n").alias("n_rows"))


def compact_deltas(spark: SparkSession, folder: str, target: str, upto: int) -> DataFrame:
    """Deltas of batches up to ``upto`` summed into one under ``target``, which has the later ones too; the folder read is left as it is."""
    d = spark.read.schema(_SUMS + ", batch long").option("basePath", folder).parquet(folder)
    old = d.where(F.col("batch") <= upto).groupBy("document_id", "profile").agg(*(F.sum(c).alias(c) for c in _ADDED)).withColumn("batch", F.lit(upto).cast("long"))
    old.unionByName(d.where(F.col("batch") > upto)).write.mode("overwrite").partitionBy("batch").parquet(target)
    return header_from_deltas(spark, target)


PROFILES = ("headline", *DIMENSIONS, "completeness")
