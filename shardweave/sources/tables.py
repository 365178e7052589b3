"""Sources (A1-A17) and sinks (B1-B8, B10-B12) of graph tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardweave.operators.partition import clean_label
from shardweave.operators.sampling import gaussian

SPACED = {"sep": " ", "header": "false"}


@dataclass(frozen=True)
class Graph:
    """Lazy tables: nodes (node_id, feat, label, split) and edges (src, dst, eid[, rel])."""

    nodes: DataFrame | None
    edges: DataFrame


def _numbered(edges: DataFrame) -> DataFrame:
    """Edges of a file scan with an eid that orders them (C3): the source's own, or the place in all files by path, however they are split."""
    if "eid" in edges.columns:
        return edges
    at = edges.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    sizes = at.groupBy("__path").agg((F.max("__row") + 1).alias("__n"))
    ahead = Window.orderBy("__path").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    before = sizes.select("__path", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    return at.join(before, "__path").select(*edges.columns, (F.col("__before") + F.col("__row")).alias("eid"))


def with_splits(nodes: DataFrame, splits: DataFrame) -> DataFrame:
    """Nodes with the split that index lists (node_id, split) give them; null elsewhere."""
    return nodes.join(splits, "node_id", "left")


def read_node_property(spark: SparkSession, path: str) -> Graph:
    """A graph already downloaded as Parquet: nodes and edges (A1); float16 features are read as float."""
    nodes = spark.read.parquet(f"{path}/nodes")
    return Graph(nodes.withColumns({"feat": F.col("feat").cast("array<float>"), "label": clean_label(F.col("label"))}), _numbered(spark.read.parquet(f"{path}/edges")))


def read_relation(spark: SparkSession, path: str, relation: str) -> Graph:
    """One relation of a graph of many (A2); partition pruning reads its files alone."""
    return Graph(None, _numbered(spark.read.parquet(f"{path}/edges").where(F.col("rel") == relation)))


def shift_relation(edges: DataFrame, relation: str, src_offset: int = 0, dst_offset: int = 0) -> DataFrame:
    """A relation's edges in a common id space (A3): ids moved behind those of the kinds before."""
    return edges.where(F.col("rel") == relation).withColumns({"src": F.col("src") + src_offset, "dst": F.col("dst") + dst_offset})


def masks_to_ids(nodes: DataFrame, mask: str) -> DataFrame:
    """A boolean column as a list of ids (A4)."""
    return nodes.where(F.col(mask)).select("node_id")


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) of a coordinate file (A5): one-based ids become zero-based; pattern files weigh one.

    Of the lines that read as the size line does, one is the size line and the
    others are edges. Symmetric and skew-symmetric files give the other half too,
    the diagonal once.
    """
    text = spark.read.text(path)
    head = text.where("_metadata.file_block_start = 0")  # the split that begins the file
    banner = (head.first() or {"value": ""})["value"].lower().split()
    lines = text.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = lines.where("_metadata.file_block_start = 0").first()
    if size is None:
        return spark.createDataFrame([], "src long, dst long, w double")
    again = lines.where(F.col("value") == size["value"]).groupBy().count().where("count > 1")
    again = again.select(F.explode(F.array_repeat(F.lit(size["value"]), (F.col("count") - 1).cast("int"))).alias("value"))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where(F.col("value") != size["value"]).unionByName(again).select(parts.alias("p"))
    weight = F.lit(1.0) if "pattern" in banner else F.coalesce(F.try_element_at("p", F.lit(3)).cast("double"), F.lit(1.0))
    rows = rows.select((F.col("p")[0].cast("long") - 1).alias("src"), (F.col("p")[1].cast("long") - 1).alias("dst"), weight.alias("w"))
    if banner[-1:] not in (["symmetric"], ["skew-symmetric"]):
        return rows
    other = rows.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (-F.col("w") if banner[-1] == "skew-symmetric" else F.col("w")).alias("w"))
    return rows.unionByName(other)


def prefix_split(node: str, labelled: int) -> Column:
    """60 / 20 / 20 of the labelled prefix, the rest without a split."""
    i = F.col(node)
    return F.when(i < labelled * 6 // 10, "train").when(i < labelled * 8 // 10, "valid").when(i < labelled, "test")


def synthetic_nodes(spark: SparkSession, n: int, width: int, train: int, test: int, valid: int, classes: int, seed: int = 0) -> DataFrame:
    """Normal features, contiguous train, test and valid blocks, random labels for train and zero else."""
    i = F.col("node_id")
    rows = gaussian(spark.range(n).withColumnRenamed("id", "node_id"), "node_id", width, seed)
    split = F.when(i < train, "train").when(i < train + test, "test").when(i < train + test + valid, "valid")
    label = F.when(i < train, F.pmod(F.xxhash64(i, F.lit(seed)), F.lit(classes))).otherwise(F.lit(0))
    return rows.withColumns({"label": label.cast("long"), "split": split})


def read_partitioner_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(part, node_id, orig_id): columns 0 and 5 of p###-*_nodes.txt (A8); the part is in the file's name."""
    raw = spark.read.options(**SPACED).schema(", ".join(f"c{i} long" for i in range(6))).csv(path)
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"p(\d+)-", 1).cast("int").alias("part"), F.col("c0").alias("node_id"), F.col("c5").alias("orig_id"))


def read_partitioner_edges(spark: SparkSession, path: str) -> DataFrame:
    """(part, src, dst): columns 0 and 1 of p###-*_edges.txt."""
    raw = spark.read.options(**SPACED).schema("src long, dst long").csv(path)
    return raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"p(\d+)-", 1).cast("int").alias("part"), "src", "dst")


def read_part(spark: SparkSession, path: str, part: int) -> Graph:
    """One part's nodes and edges (A10): only its folders are read."""
    return Graph(spark.read.parquet(f"{path}/nodes").where(F.col("part") == part), spark.read.parquet(f"{path}/edges").where(F.col("part") == part))


def read_bounds(spark: SparkSession, path: str) -> list[int]:
    """The boundary vector: one line of offsets, one a part (A10)."""
    return [int(x) for r in spark.read.text(path).collect() for x in r["value"].split()]


#: Where a log's world size and variant stand in its path.
PLACE = r".*/(\d+)proc/([^/]+)/[^/]+$"


def log_lines(files: DataFrame) -> DataFrame:
    """(path, world_size, variant, line_no, line) of whole log files, a row each; line_no counts a file's lines from zero."""
    at = F.col("_metadata.file_path")
    named = files.select(at.alias("path"), F.regexp_extract(at, PLACE, 1).try_cast("int").alias("world_size"), F.regexp_extract(at, PLACE, 2).alias("variant"), "value")
    return named.select("path", "world_size", "variant", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, world_size, variant, line_no, line) of <n>proc/<variant>/stdout*.0 under ``path`` (A15); a file is read by one task."""
    return log_lines(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "stdout*.0").text(path, wholetext=True))


@dataclass(frozen=True)
class Settings:
    """A run's settings."""

    graph_name: str = ""
    in_channels: int = 0
    hidden_channels: int = 64
    out_channels: int = 0
    num_layers: int = 3
    num_epochs: int = 100
    lr: float = 0.01
    dropout: float = 0.5
    num_bits: int = 32
    is_pre_delay: bool = False
    input_dir: str = ""
    model_name: str = "sage"
    norm_type: str = "layer"
    weight_decay: float = 0.0
    is_label_augment: bool = False
    random_seed: int = 0

    @staticmethod
    def read(text: str, **given: object) -> Settings:
        """From flat ``name: value`` lines, then what is given; names it doesn't know are an error."""
        kinds = {f.name: type(f.default) for f in fields(Settings)}
        found: dict[str, object] = {}
        for line in text.splitlines():
            if (line := line.split("#")[0].strip()) and ":" in line:
                k, v = (x.strip().strip("'\"") for x in line.split(":", 1))
                found[k] = v
        found |= {k: v for k, v in given.items() if v is not None}
        if unknown := found.keys() - kinds.keys():
            raise ValueError(f"settings not known: {sorted(unknown)}")
        read = lambda k, v: str(v).lower() in ("true", "1", "yes") if kinds[k] is bool else kinds[k](v)
        return Settings(**{k: read(k, v) for k, v in found.items()})


def input_dir(root: str, graph: str, parts: int, benchmark: bool = False) -> str:
    """Where a graph's parts lie: [ogbn_]{graph}_{parts}_part."""
    return f"{root.rstrip('/')}/{'ogbn_' if benchmark else ''}{graph}_{parts}_part/"


# Sinks


def write_graph(graph: Graph, path: str) -> None:
    """Nodes and edges as Parquet (B1), edges by relation where they have one."""
    if graph.nodes is not None:
        graph.nodes.write.parquet(f"{path}/nodes")
    out = graph.edges.write
    (out.partitionBy("rel") if "rel" in graph.edges.columns else out).parquet(f"{path}/edges")


def write_parts(rows: DataFrame, path: str, part: str = "part") -> None:
    """Rows in a folder a part (B6, B7); rows are dealt to parts first, so a part has few files, and a large part several."""
    rows.withColumn("__deal", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(8))).repartition(F.col(part), F.col("__deal")).drop("__deal").write.partitionBy(part).parquet(path)


def write_spaced(rows: DataFrame, path: str) -> None:
    """Space-separated text without a header."""
    rows.write.options(**SPACED).csv(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """One line 'N E W ' with the space at its end."""
    stats.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in stats.columns], F.lit("")).alias("value")).coalesce(1).write.text(path)


def write_bounds(bounds: DataFrame, path: str) -> None:
    """All parts' boundaries in one line (B8, Q22): zero, then every part's end; a row a part reaches the driver."""
    ends = [str(r["end"]) for r in bounds.orderBy("part").collect()]
    spark = bounds.sparkSession
    spark.createDataFrame([(" ".join(["0", *ends]),)], "value string").coalesce(1).write.text(path)


def write_wide(rows: DataFrame, path: str) -> None:
    """A report as one CSV with a header."""
    rows.coalesce(1).write.option("header", "true").csv(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table kept at ``path``: read if it is there, else made and written."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
