"""Running values in the order of each key, also for keys whose rows are far too many for one task.

A key with at most ``block`` rows is a window.  The rows of larger keys are range-partitioned by (key, order), so that such a
key is cut into blocks; windows run within a block, each block is summed up in one row, a scan over these rows carries what comes before (or
after) into every block, and the two are put together.  No task holds more than a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settled

#: Rows of a key up to which it is one window, and of a block beyond.
BLOCK = 1_000_000

# kind: whether it looks back, its value within a window, a block's part of it, how parts add up over earlier (later) blocks
_UP, _NOW, _END = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def _local(kind: str, value: Column, by) -> Column:
    past, ahead = by.rowsBetween(_UP, -1), by.rowsBetween(1, _END)
    return {
        "lag": lambda: F.lag(value).over(by), "lead": lambda: F.lead(value).over(by), "max": lambda: F.max(value).over(by.rowsBetween(_UP, _NOW)),
        "sum": lambda: F.coalesce(F.sum(value).over(past), F.lit(0)), "last": lambda: F.last(value, ignorenulls=True).over(past), "next": lambda: F.first(value, ignorenulls=True).over(ahead),
    }[kind]()


def _part(kind: str, value: Column, at: Column) -> Column:
    """What a block adds: its last or first value, its largest, its sum, its last or first value that is not null."""
    known = F.when(value.isNotNull(), at)
    return {"lag": F.max_by(value, at), "lead": F.min_by(value, at), "max": F.max(value), "sum": F.sum(value), "last": F.max_by(value, known), "next": F.min_by(value, known)}[kind]


def running(df: DataFrame, key: list[str], order: list[str], values: dict[str, tuple[str, Column]], block: int = BLOCK) -> DataFrame:
    """``df`` with a column for each of ``values`` (name: (kind, value)), in the order of ``order`` within ``key``.

    Kinds: ``lag`` and ``lead`` (the row before, after), ``max`` (so far, this row included), ``sum`` (of the rows before; 0 for the first), ``last`` and
    ``next`` (the nearest earlier, later value that is not null).  ``order`` should tell rows of a key apart; rows that it
    does not tell apart come in any order.  Null keys are one key."""
    names = [*df.columns, *values]
    size = settled(df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > block))
    within = Window.partitionBy(*key).orderBy(*order)
    add = lambda rows, by: rows.withColumns({n: _local(k, v, by) for n, (k, v) in values.items()})
    n_large = size.agg(F.sum("__n").alias("n")).first()["n"]
    if not n_large:
        return add(df, within)
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in key]
    large = df.alias("d").join(size.alias("k"), same("d", "k"), "left_semi")
    spark = df.sparkSession
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_large // block))
    # written once: the blocks of the parts below and of the rows must be the same
    rows = settled(large.repartitionByRange(n_blocks, *key, *order).withColumn("__b", F.spark_partition_id()))
    at = F.struct(*order)
    parts = rows.groupBy(*key, "__b").agg(*(_part(k, v, at).alias(f"__p_{n}") for n, (k, v) in values.items()))
    blocks = Window.partitionBy(*key).orderBy("__b")  # a row for each block
    before, after = blocks.rowsBetween(_UP, -1), blocks.rowsBetween(1, _END)
    carried = {
        n: {"lag": F.lag(p).over(blocks), "lead": F.lead(p).over(blocks), "max": F.max(p).over(before), "sum": F.sum(p).over(before), "last": F.last(p, ignorenulls=True).over(before), "next": F.first(p, ignorenulls=True).over(after)}[k]
        for n, (k, _) in values.items() for p in [F.col(f"__p_{n}")]
    }
    carry = parts.select(*key, "__b", *(c.alias(f"__c_{n}") for n, c in carried.items()))
    by = Window.partitionBy(*key, "__b").orderBy(*order)
    edge = {"__first": F.lag(F.lit(1)).over(by).isNull(), "__last": F.lead(F.lit(1)).over(by).isNull()}
    local = add(rows.withColumns(edge), by)

    def whole(n: str, kind: str) -> Column:
        mine, other = F.col(f"l.{n}"), F.col(f"c.__c_{n}")
        return {
            "lag": F.when(F.col("l.__first"), other).otherwise(mine), "lead": F.when(F.col("l.__last"), other).otherwise(mine), "max": F.greatest(mine, other),
            "sum": mine + F.coalesce(other, F.lit(0)), "last": F.coalesce(mine, other), "next": F.coalesce(mine, other),
        }[kind].alias(n)

    joined = local.alias("l").join(carry.alias("c"), [*same("l", "c"), F.col("l.__b") == F.col("c.__b")])
    done = joined.select(*(F.col(f"l.{c}") for c in df.columns), *(whole(n, k) for n, (k, _) in values.items()))
    small = add(df.alias("d").join(size.alias("k"), same("d", "k"), "left_anti"), within)
    return small.select(names).unionByName(done.select(names))
