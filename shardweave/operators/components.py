"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.runtime import settle


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One round. ``edges`` has a > b; the result links each node to its neighbourhood's least node."""
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both_ways:
        sides = sides.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if both_ways:
        links = sides.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        links = sides.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        links = links.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return links.where("a <> b").distinct()


def components(edges: DataFrame, left: str = "src", right: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` with the least node of its component.

    Returns (node, component) for each node that has an edge to another node;
    self loops, nulls and repeated edges are ignored. Each round is two
    shuffles on node ids and a written table; the number of rounds grows with
    the logarithm of the longest path. Only two counters reach the driver.
    """
    a, b = F.col(left), F.col(right)
    now = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = settle(now, "links")
    seen = None
    for _ in range(max_rounds):
        now = settle(_stars(_stars(now, True), False), "links")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labelled = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return labelled.unionByName(roots)
