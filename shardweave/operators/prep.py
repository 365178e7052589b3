"""Edge cleaning, degrees and node weights (C1-C3, D-1-D-4, F1-F5, B3, B4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def symmetrise(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, each once (D-1); columns other than src and dst go."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def without_loops(edges: DataFrame) -> DataFrame:
    """Edges between different nodes."""
    return edges.where("src <> dst")


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def first_edges(edges: DataFrame) -> DataFrame:
    """The first occurrence, by eid, of each (src, dst) (D-2); one shuffle with a partial aggregate."""
    return edges.groupBy("src", "dst").agg(F.min("eid").alias("eid"))


def later_edges(edges: DataFrame) -> DataFrame:
    """All occurrences but the first (D-3)."""
    order = Window.partitionBy("src", "dst").orderBy("eid")
    return edges.withColumn("__n", F.row_number().over(order)).where("__n > 1").select("src", "dst", "eid")


def clean(edges: DataFrame, symmetric: bool = False, loops: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """Edges without self loops and duplicates; on request symmetric first, and with a loop for each node after (eid -1)."""
    e = edges.select("src", "dst", "eid")
    if symmetric:
        e = e.union(edges.select("dst", "src", "eid"))
    kept = first_edges(without_loops(e))
    return with_loops(kept, nodes) if loops else kept


def removed(edges: DataFrame) -> DataFrame:
    """What cleaning takes out, with the reason (D-4, D4)."""
    loops = self_loops(edges).select("src", "dst", "eid", F.lit("loop").alias("reason"))
    return loops.unionByName(later_edges(without_loops(edges)).withColumn("reason", F.lit("duplicate")))


def with_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges and a loop for every node (C2); a loop there already stays as well."""
    return edges.select("src", "dst", "eid").union(nodes.select("node_id", "node_id", F.lit(-1).cast("long")))


def processed(edges: DataFrame) -> DataFrame:
    """The columns that partitioners take: src, dst, original edge id, edge type 0 (D3)."""
    return edges.select("src", "dst", "eid", F.lit(0).cast("long").alias("etype"))


def in_degree(nodes: DataFrame, edges: DataFrame, least: int = 0) -> DataFrame:
    """(node_id, deg): entries of each dst, zero for isolated nodes, raised to ``least``."""
    counts = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("deg"))
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", F.greatest(F.coalesce("deg", F.lit(0)), F.lit(least)).cast("long").alias("deg"))


def id_counts(ids: DataFrame, name: str) -> DataFrame:
    """(id, n) of every distinct id."""
    return ids.groupBy(F.col(name).alias("id")).agg(F.count(F.lit(1)).alias("n"))


def node_weights(nodes: DataFrame, edges: DataFrame, train: DataFrame) -> DataFrame:
    """Rows for a partitioner (B3, D5): type, in-degree, whether trained on, one, id. Without any trained node, the least id is marked."""
    marked = train.select("node_id").distinct().withColumn("t", F.lit(1))
    rows = in_degree(nodes, edges).join(marked, "node_id", "left")
    least = nodes.agg(F.min("node_id").alias("least")).crossJoin(train.agg(F.count(F.lit(1)).alias("n")))  # one row
    chosen = rows.crossJoin(F.broadcast(least))
    w_train = F.when(F.col("t") == 1, 1).when((F.col("n") == 0) & (F.col("node_id") == F.col("least")), 1).otherwise(0)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return chosen.select(zero.alias("node_type"), F.col("deg").alias("w_in_degree"), w_train.cast("long").alias("w_train"), one.alias("w_one"), "node_id")


def graph_stats(nodes: DataFrame, edges: DataFrame, weights: int = 3) -> DataFrame:
    """One row: nodes, edges, weights a node."""
    n, e = nodes.agg(F.count(F.lit(1)).alias("num_nodes")), edges.agg(F.count(F.lit(1)).alias("num_edges"))
    return n.crossJoin(e).withColumn("num_node_weights", F.lit(weights).cast("long"))
