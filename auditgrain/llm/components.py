"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round: every node hands its neighbours to the least node it knows."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # small star: edges point from the larger u to the smaller v
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    turned = edges.join(least, "u")
    return (
        turned.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reached.

    Each round is a few shuffles of the edge list and shrinks chains geometrically; rounds go on until one
    changes nothing.  The edge list is written to the shared checkpoint folder between rounds, and only one
    count per round reaches the driver.  Null ends and loops are ignored; no edges give no rows."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    cur = checkpointed(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    )
    before = None
    while True:
        # In a finished forest every u has one v and no v is itself a u: then u -> v is the answer.
        state = cur.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s"), F.sum("v").alias("t")
        ).first()
        now = (state["n"], state["s"], state["t"])
        if now == before or state["n"] == 0:
            break
        before = now
        cur = checkpointed(_star(_star(cur, large=True), large=False))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
