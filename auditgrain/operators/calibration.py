"""Calibration against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT


def label_of(outcome: Column, settled_positive: bool = False) -> Column:
    """1 for upheld rulings, 0 for rejected ones, null for no finding."""
    settled = F.lit(1) if settled_positive else F.lit(None).cast("int")
    return F.when(outcome.isin("upheld", "upheld_in_part"), 1).when(outcome.isin("not_upheld", "dismissed"), 0).when(outcome == "settled", settled)


def _counts(threshold: Column) -> list[Column]:
    hit, y = F.col("likelihood") > threshold, F.col("label")
    return [F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 0)).alias("tn"), F.count_if(~hit & (y == 1)).alias("fn")]


def _rates(df: DataFrame) -> DataFrame:
    c = F.col
    out = df.withColumns({
        "precision": F.try_divide(c("tp"), c("tp") + c("fp")), "recall": F.try_divide(c("tp"), c("tp") + c("fn")),
        "accuracy": F.try_divide(c("tp") + c("tn"), c("tp") + c("fp") + c("tn") + c("fn")),
    })
    return out.withColumn("f1", F.when((c("precision") > 0) & (c("recall") > 0), 2 * c("precision") * c("recall") / (c("precision") + c("recall"))))


def classification_metrics(cases: DataFrame, threshold: float = DEFAULT.threshold, few: int = DEFAULT.few_negatives) -> DataFrame:
    """One row: confusion counts, rates (null where undefined), Brier score, counts and the caveat on few negatives."""
    p, y = F.col("likelihood"), F.col("label")
    row = cases.agg(
        *_counts(F.lit(threshold)), F.avg(F.pow(p - y, 2)).alias("brier"), F.count("likelihood").alias("scored"),
        F.count_if(p.isNotNull() & y.isNotNull()).alias("labelled"), F.count_if(p.isNotNull() & y.isNull()).alias("unlabelled"), F.count_if(p.isNull()).alias("failed"),
        F.count_if(p.isNotNull() & (y == 0)).alias("negatives"),
    )
    return _rates(row).withColumn("few_negatives", F.col("negatives") < few)


def calibration_curve(cases: DataFrame, bins: int = DEFAULT.bins) -> DataFrame:
    """(bin, low, high, predicted, observed, n) of bins [low, high), the last closed; empty bins are dropped."""
    edges = [i / bins for i in range(bins + 1)]
    which = F.lit(bins - 1)
    for i in reversed(range(bins - 1)):
        which = F.when(F.col("likelihood") < edges[i + 1], i).otherwise(which)
    rows = cases.where("likelihood is not null and label is not null").withColumn("bin", which)
    out = rows.groupBy("bin").agg(F.avg("likelihood").alias("predicted"), F.avg("label").alias("observed"), F.count(F.lit(1)).alias("n"))
    table = F.array(*(F.lit(e) for e in edges))
    return out.withColumns({"low": table[F.col("bin")], "high": table[F.col("bin") + 1]})


def threshold_sweep(cases: DataFrame, thresholds: tuple[float, ...] = DEFAULT.thresholds) -> DataFrame:
    """classification counts and rates at each threshold, in one pass over the cases."""
    row = cases.agg(F.array(*(F.struct(F.lit(t).alias("threshold"), *_counts(F.lit(t))) for t in thresholds)).alias("x"))
    return _rates(row.select(F.explode("x").alias("x")).select("x.*"))


def misses(cases: DataFrame, threshold: float = DEFAULT.threshold) -> DataFrame:
    """cases with ``missed``: predicted on the wrong side; null without likelihood or label."""
    return cases.withColumn("missed", (F.col("likelihood") > threshold) != (F.col("label") == 1))


def leave_one_out(cases: DataFrame, store: DataFrame, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """For every case the store without its own entry: n_others and, for each of ``values``, ``<value>_sum`` and ``<value>_mean``.

    cases: case_id and the columns ``by``; store: entry_id, ``by`` and ``values``.  With ``by``, only entries that agree there count.  No case meets
    an entry: the sums of all entries less those of its own are what is left, so the cost is that of the two tables, not of their
    pairs.  Null values count as entries and add nothing; means are null without a value.  Cases that no other entry is left for are not given."""
    agg = [F.count(F.lit(1)).alias("n")] + [x for v in values for x in (F.sum(v).alias(f"s_{v}"), F.count(v).alias(f"k_{v}"))]
    names = ["n"] + [f"{x}_{v}" for v in values for x in "sk"]
    total = store.groupBy(*by).agg(*agg)
    own = store.groupBy(F.col("entry_id").alias("case_id"), *by).agg(*agg)
    c, t, o = cases.select("case_id", *by).alias("c"), total.alias("t"), own.alias("o")
    same = lambda a, b: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in by]
    rest = c.join(t, same("c", "t")) if by else c.crossJoin(F.broadcast(t))  # one row
    rest = rest.join(o, [F.col("c.case_id") == F.col("o.case_id"), *same("c", "o")], "left")
    left = {x: F.coalesce(F.col(f"t.{x}"), F.lit(0)) - F.coalesce(F.col(f"o.{x}"), F.lit(0)) for x in names}
    out = rest.select("c.case_id", *(F.col(f"c.{x}") for x in by), *(v.alias(k) for k, v in left.items())).where("n > 0")
    sums = [x for v in values for x in (F.when(F.col(f"k_{v}") > 0, F.col(f"s_{v}")).alias(f"{v}_sum"), F.try_divide(f"s_{v}", f"k_{v}").alias(f"{v}_mean"))]
    return out.select("case_id", *by, F.col("n").alias("n_others"), *sums)


def other_entries(cases: DataFrame, store: DataFrame) -> DataFrame:
    """(case_id, entry_id): every case with every entry of the store but its own."""
    return cases.select("case_id").crossJoin(store.select("entry_id")).where("case_id <> entry_id")


def rank_cases(cases: DataFrame) -> DataFrame:
    return cases.orderBy(F.desc_nulls_last("likelihood"), "case_id")
