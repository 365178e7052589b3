"""Parts as a column: assignment, boundaries, local ids, remapping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.operators.running import running


def part_of(node: Column, nodes: int, parts: int) -> Column:
    """Part of a node where parts are equal ranges of ids (E5); no join needed."""
    return F.floor(node / F.lit(max(1, math.ceil(nodes / parts)))).cast("long")


def assign_ranges(nodes: DataFrame, count: int, parts: int) -> DataFrame:
    return nodes.select("node_id", part_of(F.col("node_id"), count, parts).alias("part"))


def assign_hash(nodes: DataFrame, parts: int) -> DataFrame:
    return nodes.select("node_id", F.pmod(F.xxhash64("node_id"), F.lit(parts)).cast("long").alias("part"))


def assign_balanced(weights: DataFrame, parts: int, weight: str = "w_in_degree", buckets: int = 4096) -> DataFrame:
    """Contiguous parts of near-equal weight (I13): a node's part is its running weight over a part's share.

    The running sum is made in two levels, so no task sorts all nodes.
    """
    w = weights.select("node_id", (F.col(weight) + 1).cast("long").alias("w"))
    run = running(w, [], ["node_id"], F.col("w"), ranges=buckets).crossJoin(F.broadcast(w.agg(F.sum("w").alias("total"))))  # one row
    return run.select("node_id", F.floor(F.col("before") * parts / F.col("total")).cast("long").alias("part"))


def bounds(assigned: DataFrame) -> DataFrame:
    """(part, begin, end) of contiguous parts, end exclusive."""
    return assigned.groupBy("part").agg(F.min("node_id").alias("begin"), (F.max("node_id") + 1).alias("end"))


def owner(rows: DataFrame, node: str, parts: DataFrame, name: str, buckets: int = 4096) -> DataFrame:
    """The part that owns ``node``, by the boundary table (E5); rows outside all parts go.

    Ids are dealt into ``buckets`` equal ranges and each part into those it
    touches, so rows meet the few parts of their range by an equi-join.
    """
    p = parts.where("begin < end").select(F.col("part").alias(name), F.col("begin").alias("__b"), F.col("end").alias("__e"))
    ends = p.agg(F.min("__b").alias("__low"), F.ceil((F.max("__e") - F.min("__b")) / buckets).cast("long").alias("__wide"))  # one row
    bucket = lambda c: F.floor((c - F.col("__low")) / F.col("__wide")).cast("long")
    grid = p.crossJoin(F.broadcast(ends)).withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__b")), bucket(F.col("__e") - 1)))).drop("__low", "__wide")
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("__bucket", bucket(F.col(node)))
    found = placed.join(grid, (placed["__bucket"] == grid["__bucket"]) & (placed[node] >= grid["__b"]) & (placed[node] < grid["__e"]))
    return found.select(*[placed[c] for c in rows.columns], name)


def split_edges(edges: DataFrame, count: int, parts: int) -> DataFrame:
    """Edges with src_part, dst_part and is_local (C4); parts own edges by dst."""
    return edges.select("*", part_of(F.col("src"), count, parts).alias("src_part"), part_of(F.col("dst"), count, parts).alias("dst_part")).withColumn("is_local", F.col("src_part") == F.col("dst_part"))


def split_by_range(edges: DataFrame, begin: int, end: int) -> DataFrame:
    """Edges into one part [begin, end], both inclusive: dst localised; src localised where local, global where remote."""
    local = F.col("src").between(begin, end)
    return edges.select(F.when(local, F.col("src") - begin).otherwise(F.col("src")).alias("src"), (F.col("dst") - begin).alias("dst"), local.alias("is_local"))


def localise(edges: DataFrame, count: int, parts: int) -> DataFrame:
    """Split edges with src_local and dst_local, ids less their part's begin (C5); the global ids stay."""
    width = max(1, math.ceil(count / parts))
    return split_edges(edges, count, parts).withColumns({"src_local": F.col("src") - F.col("src_part") * width, "dst_local": F.col("dst") - F.col("dst_part") * width})


def remap(ids: DataFrame, node_map: DataFrame) -> DataFrame:
    """Ids by their original name to (part, local id) (E1, B7): a bag join; misses go, duplicates stay (Q21)."""
    begin = node_map.groupBy("part").agg(F.min("node_id").alias("begin"))
    named = node_map.join(begin, "part").select(F.col("orig_id").alias("id"), "part", (F.col("node_id") - F.col("begin")).alias("local_id"))
    return ids.join(named, "id").select("id", "part", "local_id")


def gather(node_map: DataFrame, nodes: DataFrame) -> DataFrame:
    """Features and labels of nodes under their new ids."""
    return node_map.join(nodes.withColumnRenamed("node_id", "orig_id"), "orig_id")


def clean_label(label: Column) -> Column:
    """NaN or null to -1, else an integer."""
    return F.coalesce(F.nanvl(label.cast("double"), F.lit(-1.0)), F.lit(-1.0)).cast("long")


def mask(nodes: DataFrame, ids: DataFrame, name: str = "mask") -> DataFrame:
    """An id list as a boolean column over all nodes."""
    marked = ids.select("node_id").distinct().withColumn("__m", F.lit(True))
    return nodes.join(marked, "node_id", "left").withColumn(name, F.col("__m").isNotNull()).drop("__m")


def edge_cut(split: DataFrame) -> DataFrame:
    """One row: edges, and those between parts."""
    return split.agg(F.count(F.lit(1)).alias("edges"), F.count_if(~F.col("is_local")).alias("cut"))


def balance(split: DataFrame, assigned: DataFrame) -> DataFrame:
    """(part, nodes, in_edges, cut_in): how even an assignment is."""
    n = assigned.groupBy("part").agg(F.count(F.lit(1)).alias("nodes"))
    e = split.groupBy(F.col("dst_part").alias("part")).agg(F.count(F.lit(1)).alias("in_edges"), F.count_if(~F.col("is_local")).alias("cut_in"))
    return n.join(e, "part", "left").fillna(0, ["in_edges", "cut_in"])
