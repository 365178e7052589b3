"""Layers, stacks of layers, accuracy, Adam and checkpoints (L1-L5, L11, L13, F15, B10, A14). Weights live on the driver: their size is the model's, never the data's."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardweave.functions import dense as d
from shardweave.operators.aggregate import aggregate
from shardweave.operators.aggregate import dense as all_nodes
from shardweave.operators.normalise import batch_norm, by_degree, layer_norm
from shardweave.operators.prep import in_degree
from shardweave.runtime import settle


def mean_neighbours(edges: DataFrame, feats: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    rows = all_nodes(nodes, aggregate(edges, feats, width), width)
    return by_degree(rows, in_degree(nodes, edges, 1))


def sage_layer(edges: DataFrame, feats: DataFrame, nodes: DataFrame, w_neigh: np.ndarray, w_self: np.ndarray, bias: np.ndarray) -> DataFrame:
    """mean of neighbours @ w_neigh + own row @ w_self + bias (L1)."""
    near = d.linear(mean_neighbours(edges, feats, nodes, w_neigh.shape[0]), w_neigh)
    own = d.linear(feats, w_self, bias).withColumnRenamed("feat", "own")
    return near.join(own, "node_id").select("node_id", d.add_rows(F.col("feat"), F.col("own")).alias("feat"))


def gcn_layer(norm_edges: DataFrame, feats: DataFrame, nodes: DataFrame, w: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(weighted sum of neighbours) @ w + bias (L2); where w narrows, rows are multiplied before they are summed."""
    into, out = w.shape
    if out < into:
        rows = all_nodes(nodes, aggregate(norm_edges, d.linear(feats, w), out, "sum", "w"), out)
        return rows.select("node_id", F.zip_with("feat", F.array(*map(F.lit, bias.tolist())), lambda x, b: x + b).alias("feat"))
    return d.linear(all_nodes(nodes, aggregate(norm_edges, feats, into, "sum", "w"), into), w, bias)


def old_sage_layer(edges: DataFrame, feats: DataFrame, nodes: DataFrame, w: np.ndarray, bias: np.ndarray) -> DataFrame:
    """((sum of neighbours + own row) / (degree + 1)) @ w + bias (L3), multiplied first where w narrows."""
    narrow = w.shape[1] < w.shape[0]
    rows = d.linear(feats, w) if narrow else feats.select("node_id", F.col("feat").cast("array<double>").alias("feat"))
    width = w.shape[1] if narrow else w.shape[0]
    total = all_nodes(nodes, aggregate(edges, rows, width), width).join(rows.withColumnRenamed("feat", "own"), "node_id")
    deg = in_degree(nodes, edges)
    mean = total.join(deg, "node_id").select("node_id", F.transform(d.add_rows(F.col("feat"), F.col("own")), lambda x: x / (F.col("deg") + 1)).alias("feat"))
    b = F.array(*map(F.lit, bias.tolist()))
    return mean.select("node_id", F.zip_with("feat", b, lambda x, y: x + y).alias("feat")) if narrow else d.linear(mean, w, bias)


def between(rows: DataFrame, width: int, norm: str = "layer", rate: float = 0.0, salt: int = 0) -> DataFrame:
    """What stands between two layers, in this order: dropout, norm, relu."""
    rows = rows.select("node_id", d.dropout(F.col("feat"), F.col("node_id"), rate, salt).alias("feat"))
    if norm == "layer":
        rows = rows.select("node_id", layer_norm(F.col("feat"), width).alias("feat"))
    elif norm in ("batch", "batch_global"):
        rows = batch_norm(rows, width, norm == "batch")
    return rows.select("node_id", d.relu(F.col("feat")).alias("feat"))


def predict(layer, feats: DataFrame, weights: list[tuple], norm: str = "layer") -> DataFrame:
    """(node_id, feat): log probabilities of a stack of layers (L5); ``layer(rows, *weights)`` applies one."""
    rows = feats
    for i, w in enumerate(weights):
        rows = layer(rows, *w)
        if i + 1 < len(weights):
            rows = settle(between(rows, w[0].shape[1], norm), "layer")
    return rows.select("node_id", d.softmax_log(F.col("feat")).alias("feat"))


def accuracy(logp: DataFrame, labels: DataFrame) -> DataFrame:
    """(split, correct, total, loss) by split, loss the summed NLL of labelled rows."""
    rows = logp.join(labels, "node_id").where("label >= 0")
    return rows.groupBy("split").agg(
        F.count_if(d.argmax(F.col("feat")) == F.col("label")).alias("correct"), F.count(F.lit(1)).alias("total"), F.sum(d.nll(F.col("feat"), F.col("label"))).alias("loss")
    )


@dataclass
class Adam:
    """Adam with a rate and a decay for each group of parameters."""

    rates: list[float]
    decays: list[float]
    b1: float = 0.9
    b2: float = 0.999
    eps: float = 1e-8
    t: int = 0
    m: list = field(default_factory=list)
    v: list = field(default_factory=list)

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        if not self.m:
            self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        self.t += 1
        for p, g, m, v, rate, decay in zip(params, grads, self.m, self.v, self.rates, self.decays, strict=True):
            g = g + decay * p
            m += (1 - self.b1) * (g - m)
            v += (1 - self.b2) * (g * g - v)
            p -= rate * (m / (1 - self.b1**self.t)) / (np.sqrt(v / (1 - self.b2**self.t)) + self.eps)


def glorot(rng: np.random.Generator, into: int, out: int, gain: float = 2**0.5) -> np.ndarray:
    top = gain * (6 / (into + out)) ** 0.5
    return rng.uniform(-top, top, (into, out))


def save_weights(spark: SparkSession, path: str, weights: dict[str, list[np.ndarray]]) -> None:
    """A checkpoint as a table (layer, name, i, j, w)."""
    cells = [(layer, str(k), i, j, float(x)) for layer, ws in weights.items() for k, w in enumerate(ws) for i, row in enumerate(np.atleast_2d(w)) for j, x in enumerate(row)]
    spark.createDataFrame(cells, "layer string, name string, i int, j int, w double").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, list[np.ndarray]]:
    """The checkpoint's weights, bounded by the model (A14); vectors come back as one row."""
    out: dict[str, dict[str, dict]] = {}
    for r in spark.read.parquet(path).collect():
        out.setdefault(r["layer"], {}).setdefault(r["name"], {})[r["i"], r["j"]] = r["w"]
    made = {}
    for layer, ws in out.items():
        made[layer] = []
        for _, cells in sorted(ws.items()):
            m = np.zeros((max(i for i, _ in cells) + 1, max(j for _, j in cells) + 1))
            for at, x in cells.items():
                m[at] = x
            made[layer].append(m)
    return made
