"""Graphs of known kinds by name (A1-A7, A16), each from the files that its publishers give out, already downloaded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardweave.operators.partition import clean_label
from shardweave.sources.arrays import read_npy, read_npy_edges, read_raw_floats
from shardweave.sources.tables import Graph, prefix_split, read_matrix_market, read_node_property, read_part, read_relation, synthetic_nodes, with_splits

#: Fixed sizes of the published sets.
PAPERS_260M, LABELLED_260M, WIDTH_260M = 269346174, 227130858, 1024
PROTEINS = {"n": 8745542, "width": 128, "train": 1000000, "test": 500000, "valid": 5000, "classes": 256}


def ids_to_split(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """(node_id, split) of index lists, one .npy of ids for each split (A11); ``names`` has a path below ``path`` for each."""
    out = None
    for split, name in names.items():
        one = read_npy(spark, f"{path}/{name}", "node_id").select("node_id", F.lit(split).alias("split"))
        out = one if out is None else out.unionByName(one)
    return out


def read_index_lists(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """(node_id, split) of {graph}_nodes_{train,valid,test}_idx.npy."""
    return ids_to_split(spark, path, {s: f"{graph}_nodes_{s}_idx.npy" for s in ("train", "valid", "test")})


def mag_citations(spark: SparkSession, path: str) -> Graph:
    """The citation relation of a graph of papers, authors and institutions (A2): half-precision features, labels with NaN, index lists."""
    feats = read_npy(spark, f"{path}/paper/node_feat.npy", "feat").select(F.col("row").alias("node_id"), F.col("feat").cast("array<float>").alias("feat"))
    labels = read_npy(spark, f"{path}/paper/node_label.npy", "label").select(F.col("row").alias("node_id"), clean_label(F.col("label")).alias("label"))
    splits = ids_to_split(spark, f"{path}/split", {"train": "train.npy", "valid": "valid.npy", "test": "test-dev.npy"})
    return Graph(with_splits(feats.join(labels, "node_id", "left"), splits), read_npy_edges(spark, f"{path}/paper___cites___paper/edge_index.npy"))


def mag_affiliations(spark: SparkSession, path: str, authors: int) -> Graph:
    """Authors and their institutions in one id space (A3): institutions come after the ``authors``."""
    e = read_npy_edges(spark, f"{path}/author___affiliated_with___institution/edge_index.npy")
    return Graph(None, e.withColumn("dst", F.col("dst") + authors))


def masked_posts(spark: SparkSession, path: str) -> Graph:
    """Nodes with boolean columns train_mask, val_mask and test_mask, as Parquet (A4)."""
    g = read_node_property(spark, path)
    split = F.when(F.col("train_mask"), "train").when(F.col("val_mask"), "valid").when(F.col("test_mask"), "test")
    return Graph(g.nodes.withColumn("split", split).drop("train_mask", "val_mask", "test_mask"), g.edges)


def proteins(spark: SparkSession, path: str, **sizes: int) -> Graph:
    """A MatrixMarket graph with invented features, labels and splits."""
    return Graph(synthetic_nodes(spark, **{**PROTEINS, **sizes}), read_matrix_market(spark, f"{path}/proteins.mtx"))


def papers_260m(spark: SparkSession, path: str, n: int = PAPERS_260M, labelled: int = LABELLED_260M, width: int = WIDTH_260M) -> Graph:
    """Raw features and labels of fixed shape and a transposed edge array; 60, 20 and 20 % of the labelled prefix."""
    at = f"{path}/processed"
    feats = read_raw_floats(spark, f"{at}/paper/node_feat.npy", width).where(F.col("row") < n).select(F.col("row").alias("node_id"), "feat")
    labels = read_raw_floats(spark, f"{at}/paper/node_label_19.npy", 1).where(F.col("row") < n).select(F.col("row").alias("node_id"), clean_label(F.col("value")).alias("label"))
    return Graph(feats.join(labels, "node_id", "left").withColumn("split", prefix_split("node_id", labelled)), read_npy_edges(spark, f"{at}/paper__cites__paper/edge_index.npy"))


LOADERS: dict[str, Callable[..., Graph]] = {
    "node-property": read_node_property, "relation": read_relation, "part": read_part, "mag240M": mag_citations, "mag240M-affiliations": mag_affiliations,
    "reddit": masked_posts, "proteins": proteins, "IGB260M": papers_260m,
}


def load(kind: str, *args: object, **sizes: int) -> Graph:
    """A loader by name."""
    if kind not in LOADERS:
        raise ValueError(f"no loader {kind!r}; there are {sorted(LOADERS)}")
    return LOADERS[kind](*args, **sizes)
