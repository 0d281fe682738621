"""Numbering and ranking of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """df with its global place in ``order`` from 1, without a single-task window.

    Rows are range-partitioned and sorted; each partition's size is a tiny aggregate, whose running
    sum gives the first place of the partition."""
    from ..scratch import settled

    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__p", F.spark_partition_id())
    # materialised once: the ranges must be the same for the sizes and the rows
    dealt = settled(dealt)
    sizes = sorted((r["__p"], r["n"]) for r in dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())
    start, rows = 0, []
    for p, n in sizes:
        rows.append((p, start))
        start += n
    firsts = spark.createDataFrame(rows or [(0, 0)], "__p int, __first long")  # one row for each partition
    within = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return dealt.withColumn("__r", within).join(F.broadcast(firsts), "__p").withColumn(name, F.col("__first") + F.col("__r")).drop("__p", "__r", "__first")


def top_k(df: DataFrame, partition_by: list[str], order_by: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """df with its rank in each partition, and only the first ``k`` where given."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by)))
    return out if k is None else out.where(F.col(name) <= k)


def dedupe(df: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """One row for each key with the number of ``ignored`` others; keep='error' returns the offending rows instead."""
    by = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(by)
    if keep == "error":
        return df.withColumn("n_rows", n).where("n_rows > 1")
    turn = [c.desc() for c in order] if keep == "last" else [c.asc() for c in order]
    out = df.withColumn("__r", F.row_number().over(by.orderBy(*turn))).withColumn("ignored", n - 1)
    return out.where("__r = 1").drop("__r")


def collapse_runs(df: DataFrame, key: list[str], order: list[Column], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*key).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__b", before).withColumn("__n", first).where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__b"))).drop("__b", "__n")


def keep_ends(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows of each key: the first half and the last half in order."""
    up = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    total = F.count(F.lit(1)).over(Window.partitionBy(*key))
    head, tail = n // 2, n - n // 2
    return df.withColumn("__u", up).withColumn("__t", total).where((F.col("__t") <= n) | (F.col("__u") <= head) | (F.col("__u") > F.col("__t") - tail)).drop("__u", "__t")


def number_rows(df: DataFrame, key: list[str], order: list[Column], prefix: str, name: str = "id") -> DataFrame:
    """Ids like C1, C2 in order within each key."""
    return df.withColumn(name, F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("string")))
