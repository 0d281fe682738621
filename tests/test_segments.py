"""Running values in blocks against one loop over all rows, and the order rules of a huge analysis."""

import random

import pytest
from pyspark.sql import functions as F

from auditgrain.operators import eventlog as ev
from auditgrain.operators.segments import running


def kinds():
    return {k: (k, F.col("v")) for k in ("lag", "lead", "max", "sum", "last", "next")}


def loop(rows):
    out = {}
    for key in {k for k, _, _ in rows}:
        own = sorted((s, v) for k, s, v in rows if k == key)
        values = [v for _, v in own]
        for i, (s, _) in enumerate(own):
            past, ahead = [v for v in values[:i] if v is not None], [v for v in values[i + 1 :] if v is not None]
            so_far = past + ([values[i]] if values[i] is not None else [])
            out[key, s] = (values[i - 1] if i else None, values[i + 1] if i + 1 < len(own) else None, max(so_far, default=None), sum(past), past[-1] if past else None, ahead[0] if ahead else None)
    return out


@pytest.mark.parametrize("block", [1, 7, 60, 10_000])
def test_running_equals_loop(spark, block):
    """One hot key with most rows, small ones, a null key, runs of nulls longer than a block."""
    rng = random.Random(block)
    rows = [(k, s, None if s % 50 > 20 and k == 1 else rng.choice([None, *range(9)])) for k, n in ((1, 300), (2, 9), (3, 1), (None, 40)) for s in range(n)]
    rng.shuffle(rows)
    got = running(spark.createDataFrame(rows, "k int, s int, v int"), ["k"], ["s"], kinds(), block).collect()
    assert len(got) == len(rows)
    assert {(r.k, r.s): (r.lag, r.lead, r.max, r.sum, r["last"], r.next) for r in got} == loop(rows)


def test_running_of_an_empty_table(spark):
    assert running(spark.createDataFrame([], "k int, s int, v int"), ["k"], ["s"], kinds(), 1).count() == 0


def test_hot_analysis_is_checked_in_blocks(spark):
    """A third of a million events of one analysis, checked as in one window; no block has more than its share of rows."""
    n = 300_000
    log = spark.range(n).select(F.lit(1).alias("analysis_id"), (F.col("id") + F.when(F.col("id") >= 200_000, 1).otherwise(0)).alias("seq"), (F.col("id") * 2 - F.when(F.col("id") % 99_999 == 5, 9).otherwise(0)).alias("t_ms"),
                                F.when(F.col("id") == 0, "analysis.started").when(F.col("id") == n - 2, "analysis.completed").otherwise("x").alias("type"))
    got = {(r.seq, r.rule) for r in ev.envelope_violations(log, block=20_000).collect()}
    late = {i + (i >= 200_000) for i in range(n) if i % 99_999 == 5}
    assert got == {(200_001, "seq"), (n - 1, "after_terminal"), (n, "not_terminated")} | {(s, "t_ms") for s in late}
    whole = {(r.seq, r.rule) for r in ev.envelope_violations(log).collect()}
    assert got == whole
