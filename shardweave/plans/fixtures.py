"""The graph that queries run on, derived from the driver's tables, and the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 4
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count(spark: SparkSession, sf_dir: str) -> int:
    """Nodes; read from the files' footers."""
    return table(spark, sf_dir, "embeddings").count()


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("embedding").alias("feat"), F.col("label").cast("long").alias("label"))


def raw_edges(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """(src, dst, eid); eid orders occurrences of an edge. ``sparse`` is the graph whose exchange volumes are known by other means; only the queries of volumes take it."""
    n = count(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem")
    if sparse:
        rows = rows.where("l_quantity >= 50")
    eid = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")
    return rows.select((F.col("l_partkey") % n).alias("src"), (F.col("l_orderkey") % n).alias("dst"), eid.alias("eid"))


def edges(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    return raw_edges(spark, sf_dir, sparse).where("src <> dst").select("src", "dst").distinct()


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, split): contiguous blocks, 60 % train, 20 % test, 20 % valid."""
    n = count(spark, sf_dir)
    i = F.col("node_id")
    return nodes(spark, sf_dir).select("node_id", F.when(i < n * 6 // 10, "train").when(i < n * 8 // 10, "test").otherwise("valid").alias("split"))


#: Common table expressions to put before a query.
SQL = f"""
n AS (SELECT count(*)::BIGINT AS c FROM embeddings),
nodes AS (SELECT vec_id AS node_id, embedding AS feat, label::BIGINT AS label FROM embeddings),
raw_dense AS (SELECT l_partkey % c AS src, l_orderkey % c AS dst, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS eid FROM lineitem, n),
raw_sparse AS (SELECT l_partkey % c AS src, l_orderkey % c AS dst, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS eid FROM lineitem, n WHERE l_quantity >= 50),
dense AS (SELECT DISTINCT src, dst FROM raw_dense WHERE src <> dst),
sparse AS (SELECT DISTINCT src, dst FROM raw_sparse WHERE src <> dst),
w AS (SELECT ceil(c / {PARTS}.0)::BIGINT AS width FROM n),
part AS (SELECT node_id, node_id // width AS part FROM nodes, w),
cut AS (SELECT src, dst, src // width AS src_part, dst // width AS dst_part FROM dense, w WHERE src // width <> dst // width),
cut_sparse AS (SELECT src, dst, src // width AS src_part, dst // width AS dst_part FROM sparse, w WHERE src // width <> dst // width),
split AS (SELECT node_id, CASE WHEN node_id < c * 6 // 10 THEN 'train' WHEN node_id < c * 8 // 10 THEN 'test' ELSE 'valid' END AS split FROM nodes, n),
f AS (SELECT node_id, unnest(feat)::DOUBLE AS v, (generate_subscripts(feat, 1) - 1)::INTEGER AS j FROM nodes)
"""


def with_graph(query: str) -> str:
    return f"WITH RECURSIVE {SQL.strip()}{query if query.lstrip().startswith(',') else chr(10) + query}"
