"""A graph in parts with its exchange plan, from settings to sums (A12, A13, J9, J11): what a run loads once and every layer uses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardweave.functions.codec import PLAIN, Codec, choose_codec
from shardweave.operators import exchange, gnn, partition
from shardweave.operators.aggregate import aggregate
from shardweave.operators.prep import in_degree
from shardweave.runtime import settle
from shardweave.sources.tables import Settings, read_bounds

KINDS = ("plain", "pre", "degree", "cover")


@dataclass(frozen=True)
class Halo:
    """``local`` edges (src, dst[, w]), ``planned`` cut edges (src, dst, src_part, dst_part, mode[, w]), ``degrees`` (node_id, deg), how rows cross while training."""

    local: DataFrame
    planned: DataFrame
    degrees: DataFrame
    parts: int
    codec: Codec = PLAIN

    def volumes(self) -> DataFrame:
        return exchange.volumes(self.planned, self.parts)

    def sends(self) -> DataFrame:
        return exchange.sent(self.planned)

    def receives(self) -> DataFrame:
        return exchange.received(self.planned)

    def sums(self) -> gnn.Sums:
        """Weighted sums with the cut exchanged as planned, both ways; packed in training, plain in evaluation (Q14)."""
        turned = self.local.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in self.local.columns if c == "w"])
        back = exchange.reversed_plan(self.planned)
        w = "w" if "w" in self.planned.columns else None
        run = lambda local, planned: lambda rows, width, training: exchange.aggregate_planned(local, planned, rows, width, w, self.codec if training else PLAIN)
        return gnn.Sums(run(self.local, self.planned), run(turned, back))

    def whole(self, rows: DataFrame, width: int) -> DataFrame:
        """The same sums without a plan, to hold it against."""
        w = "w" if "w" in self.planned.columns else None
        keep = ["src", "dst", *([w] if w else [])]
        return aggregate(self.local.select(*keep).unionByName(self.planned.select(*keep)), rows, width, "sum", w)


def build(split: DataFrame, nodes: DataFrame, parts: int, kind: str = "plain", codec: Codec = PLAIN) -> Halo:
    """The plan of split edges (src, dst, src_part, dst_part, is_local[, w]).

    plain: every source row that a part needs is sent to it once. pre: every sum
    is made before it is sent. degree, cover: decided for each edge.
    """
    if kind not in KINDS:
        raise ValueError(f"kind: one of {KINDS}")
    keep = ["src", "dst", *(["w"] if "w" in split.columns else [])]
    split = settle(split.select(*keep, "src_part", "dst_part", "is_local"), "split")
    cut = exchange.cut_edges(split).drop("is_local")
    modes = {"plain": lambda c: exchange.constant_modes(c, "post"), "pre": lambda c: exchange.constant_modes(c, "pre"), "degree": exchange.degree_modes, "cover": exchange.cover_modes}
    return Halo(split.where("is_local").select(*keep), settle(modes[kind](cut), "planned"), in_degree(nodes, split), parts, codec)


@dataclass(frozen=True)
class Run:
    settings: Settings
    nodes: DataFrame  # node_id, feat, label, split
    halo: Halo

    def spec(self) -> gnn.Spec:
        s = self.settings
        widths = (s.in_channels, *[s.hidden_channels] * (s.num_layers - 1), s.out_channels)
        return gnn.Spec(s.model_name, widths, s.norm_type == "layer", s.dropout, 0.62 if s.is_label_augment else 0.0)

    def train(self, checkpoint: str | None = None, epochs: int | None = None) -> gnn.Fit:
        s = self.settings
        return gnn.fit(self.spec(), self.halo.sums(), self.nodes, epochs or s.num_epochs, s.lr, s.weight_decay, seed=s.random_seed, checkpoint=checkpoint)


def load(spark: SparkSession, settings: Settings) -> Run:
    """Nodes, edges and boundaries of ``settings.input_dir`` (folders nodes and edges by part, bounds), weighted for the model, with the plan the settings ask for: plain, or by covers where ``is_pre_delay``."""
    at = settings.input_dir.rstrip("/")
    nodes = spark.read.parquet(f"{at}/nodes")
    ends = read_bounds(spark, f"{at}/bounds")  # a number a part
    bounds = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))], "part long, begin long, end long")
    edges = gnn.weighted(settings.model_name, spark.read.parquet(f"{at}/edges").select("src", "dst"), nodes)
    placed = partition.owner(partition.owner(edges, "src", bounds, "src_part"), "dst", bounds, "dst_part")
    split = placed.withColumn("is_local", F.col("src_part") == F.col("dst_part"))
    codec = choose_codec(settings.num_bits)
    return Run(settings, nodes.select("node_id", "feat", "label", "split"), build(split, nodes, len(ends) - 1, "cover" if settings.is_pre_delay else "plain", codec))
