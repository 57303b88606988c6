"""Connected components of an undirected graph as repeated large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import materialise


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours; partial aggregation makes a hub one row a task."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Labels of the nodes that ``links`` (a, b: long) names.

    Returns node, label: the smallest node that can be reached. Self-links and nulls are ignored, repeated links
    count once, no links give an empty table. A hub with most of all links stays one row a task while it is
    aggregated, and the joins leave its rows to Spark's skew handling.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = materialise(pairs, "links")
    for _ in range(most_rounds):
        # large star: neighbours above a node are tied to the smallest node around it
        around = _both_ways(pairs)
        large = around.join(_min_neighbour(around), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        large = large.where("a < b").distinct()
        # small star: a node and its neighbours below it are tied to the smallest of them
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.*")
        after = materialise(small.where("a < b").distinct(), "links")
        # done when every node hangs on one root and no root hangs on another
        roots = after.groupBy("b").agg(F.min("a").alias("a"), F.count("*").alias("n"))
        pending = roots.where("n > 1").select("b").unionByName(after.join(after.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("b"))
        pairs = after
        if pending.isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(pairs.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
