"""Dense per-row operators on feature arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.operators.normalise import bind

#: Weights of up to this many cells become literals of the plan; larger ones go to Arrow batches.
LITERAL = 4096


def matmul(feat: Column, weights: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """feat @ weights + bias, for small weights, without leaving the JVM."""
    return bind(feat, lambda x: _product(x, weights, bias))


def _product(feat: Column, weights: np.ndarray, bias: np.ndarray | None) -> Column:
    cols = [F.aggregate(F.zip_with(feat, F.array(*map(F.lit, w.tolist())), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v) for w in weights.T.astype(float)]
    return F.array(*[c + F.lit(float(bias[j])) if bias is not None else c for j, c in enumerate(cols)])


def linear(rows: DataFrame, weights: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """(node_id, feat) with feat @ weights + bias; weights are bounded by the model, never by the data."""
    if weights.size <= LITERAL:
        return rows.select("node_id", matmul(F.col("feat"), weights, bias).alias("feat"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
            y = x @ weights + (0 if bias is None else bias)
            out = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), weights.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["node_id", "feat"])

    return rows.select("node_id", "feat").mapInArrow(run, "node_id long, feat array<double>")


def relu(feat: Column) -> Column:
    return F.transform(feat, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def dropout(feat: Column, node: Column, rate: float, salt: int = 0) -> Column:
    """Cells drop out by a hash of node, cell and salt; the others grow by 1 / (1 - rate)."""
    if rate <= 0:
        return feat
    u = lambda j: F.pmod(F.xxhash64(node, j, F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    return F.transform(feat, lambda x, j: F.when(u(j) < rate, F.lit(0.0)).otherwise(x / (1 - rate)))


def softmax_log(feat: Column) -> Column:
    """x - max - ln(sum(exp(x - max)))."""

    def out(x: Column) -> Column:
        total = F.aggregate(F.transform(x, F.exp), F.lit(0.0), lambda s, v: s + v)
        return bind(F.ln(total), lambda t: F.transform(x, lambda v: v - t))

    return bind(bind(F.array_max(feat).cast("double"), lambda m: F.transform(feat, lambda v: v.cast("double") - m)), out)


def argmax(feat: Column) -> Column:
    """The first place of the maximum (H3)."""
    return bind(feat, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("long"))


def nll(logp: Column, label: Column) -> Column:
    """Less the log probability of the label (L11); null where the label is null or -1."""
    return F.when(label >= 0, -F.get(logp, label.cast("int")))


def add_rows(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def label_rows(rows: DataFrame, labels: DataFrame, table: np.ndarray, join: bool = False) -> DataFrame:
    """Masked label augmentation (L9, E9): the embedding of a node's label added to its row, or put after it; zeros for unmasked nodes.

    ``labels`` (node_id, label) has the masked nodes; ``table`` a row a class.
    """
    classes, width = table.shape
    entries = rows.sparkSession.createDataFrame([(i, table[i].tolist()) for i in range(classes)], "label long, emb array<double>")
    marked = labels.select("node_id", "label").join(F.broadcast(entries), "label").select("node_id", "emb")  # a row a class
    emb = F.coalesce("emb", F.array_repeat(F.lit(0.0), width))
    x = F.col("feat").cast("array<double>")
    return rows.join(marked, "node_id", "left").select("node_id", (F.concat(x, emb) if join else add_rows(x, emb)).alias("feat"))


def _scaled(feat: Column, by: float) -> Column:
    return F.transform(feat, lambda v: v * by)


def select_features(inputs: list[DataFrame], weights: list[np.ndarray], attention: np.ndarray, how: str = "concat", normalise: bool = True) -> DataFrame:
    """Per input softmax(attention) times the (L2-normalised) linear image, concatenated or summed, then relu."""
    from shardweave.operators.normalise import l2

    share = np.exp(attention - attention.max())
    share = share / share.sum()
    out = None
    for i, (rows, w) in enumerate(zip(inputs, weights, strict=True)):
        image = l2(F.col("feat")) if normalise else F.col("feat")
        one = linear(rows, w).select("node_id", _scaled(image, float(share[i])).alias(f"f{i}"))
        out = one if out is None else out.join(one, "node_id")
    parts = [F.col(f"f{i}") for i in range(len(inputs))]
    whole = F.concat(*parts)
    if how == "sum":
        whole = parts[0]
        for p in parts[1:]:
            whole = add_rows(whole, p)
    return out.select("node_id", relu(whole).alias("feat"))
