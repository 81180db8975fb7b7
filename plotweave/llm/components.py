"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.llm.common import staged
from plotweave.scratch import discard


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(
        F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m"))
    return moved.union(least).toDF("a", "b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    ``edges`` has two columns of one ordered type, a and b; null ends and loops are left out, a
    repeated edge counts once. Large-star and small-star steps alternate until the edges stand
    still, in a number of rounds that grows with the logarithm of the graph. Every step is a
    pre-aggregated minimum and a join; its edges are written to the shared folder and the step
    before is deleted. Nothing but two counts reaches the driver.
    """
    spark = edges.sparkSession
    now, path = staged(edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        "a is not null and b is not null and a <> b").distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
        new, new_path = staged(_small_star(_large_star(now)), "edges")
        discard(spark, path)
        now, path = new, new_path
