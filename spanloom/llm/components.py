"""Connected components of an edge table by alternating large and small stars (distributed, iterative)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over (a, b); minima are aggregated first, so a hub is no single task."""
    flipped = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    if large:
        around = edges.unionByName(flipped)
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = around.join(low, "a")
    if large:
        out = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label) of every node in the edges (a, b): the label is the component's least node."""
    spark = edges.sparkSession
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most):
        new = materialize(_stars(_stars(now, True), False), "stars")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        remove(spark, now.spanloom_path)
        now = new
        if state == seen or not state[0]:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
