"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import drop, written


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b): any two comparable columns, self-loops and repeats allowed, nulls ignored.

    Returns (node, root) with one row for each node that has an edge to another; root is the smallest node of
    its component. Only two-row digests come to the driver. Minima are combined before each shuffle and written before
    they are joined to the edges, which are written too: both sides of a join are plain exchanges, so adaptive execution
    can split a hub's edges.
    """
    spark, pairs = edges.sparkSession, edges.where("a <> b")
    now, path = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _digest(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low, low_path = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large, large_path = written(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least, least_path = written(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, new_path = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        drop(spark, path, low_path, large_path, least_path)
        path, before, state = new_path, state, _digest(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
