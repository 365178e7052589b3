"""Full-batch training of graph models (L5, L9-L13, F10, F11, F20, B10, H4): SAGE and GCN with gradients through the aggregation, and models of pre-propagated rows.

Node rows stay in tables; only parameters, their gradients and a row a split
reach the driver. A layer is a weighted sum along the edges (a shuffle) and a
dense step (Arrow batches); its backward step is the dense step's gradient and a
sum along the edges turned round. Each task gives one partial gradient, of the
model's size; partials are summed in groups before the driver adds the groups.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.functions import dense as d
from shardweave.functions.quantise import share
from shardweave.operators import aggregate as agg
from shardweave.operators import model
from shardweave.operators.normalise import symmetric, unit_loops
from shardweave.operators.prep import in_degree
from shardweave.runtime import discard, settle

Params = dict[str, np.ndarray]
Rows = Callable[[DataFrame, int, bool], DataFrame]
EPS = 1e-5
_GROUPS = 64


@dataclass(frozen=True)
class Sums:
    """(node_id, feat) tables summed along weighted edges, and along the edges turned round; the flag tells of training."""

    forward: Rows
    back: Rows


def over_edges(edges: DataFrame) -> Sums:
    """Sums along (src, dst, w)."""
    return Sums(lambda rows, width, _: agg.aggregate(edges, rows, width, "sum", "w"), lambda rows, width, _: agg.aggregate(edges, rows, width, "sum", "w", "src"))


def mean_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with w, one over the in-degree: sums are then means (L1, L4)."""
    deg = in_degree(nodes, edges, 1).select(F.col("node_id").alias("dst"), "deg")
    return edges.join(deg, "dst").select(*[c for c in edges.columns if c != "w"], (1.0 / F.col("deg")).alias("w"))


def weighted(kind: str, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The weighted edges that a kind of model sums along."""
    return mean_weights(edges, nodes) if kind == "sage" else symmetric(unit_loops(edges, nodes), nodes)


@dataclass(frozen=True)
class Spec:
    """``widths``: of the input, of every hidden layer, of the classes. ``label_rate``: the share of train nodes whose labels are input, as embeddings added to the row or, ``label_width`` wide, put after it."""

    kind: str
    widths: tuple[int, ...]
    norm: bool = True
    dropout: float = 0.0
    label_rate: float = 0.0
    label_width: int = 0

    @property
    def layers(self) -> int:
        return len(self.widths) - 1

    def into(self, layer: int) -> int:
        return self.widths[layer] + (self.label_width if layer == 0 and self.label_rate else 0)


def init(spec: Spec, seed: int = 0) -> Params:
    if spec.kind not in ("sage", "gcn"):
        raise ValueError("kind: sage or gcn")
    rng, out = np.random.default_rng(seed), {}
    if spec.label_rate:
        out["labels"] = rng.normal(size=(spec.widths[-1], spec.label_width or spec.widths[0]))
    for i in range(spec.layers):
        a, b = spec.into(i), spec.widths[i + 1]
        out[f"near{i}"] = model.glorot(rng, a, b)
        if spec.kind == "sage":
            out[f"own{i}"] = model.glorot(rng, a, b)
        out[f"bias{i}"] = np.zeros(b)
        if spec.norm and i + 1 < spec.layers:
            out[f"gain{i}"], out[f"shift{i}"] = np.ones(b), np.zeros(b)
    return out


def drop_mask(node: np.ndarray, width: int, rate: float, salt: int) -> np.ndarray:
    """Zero for cells that drop out, 1 / (1 - rate) for others; the same for a node, cell and salt wherever it runs."""
    cell = np.arange(width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt * 2 + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
    x = node.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0xA0761D6478BD642F) + cell[None, :]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53 >= rate) / (1 - rate)


def layer(spec: Spec, params: Params, i: int, node: np.ndarray, own: np.ndarray, near: np.ndarray, salt: int | None) -> tuple[np.ndarray, tuple | None]:
    """A layer's output and what its gradient needs: dense step, then (but after the last) dropout, norm, relu (Q19). ``salt`` None: no dropout."""
    z = near @ params[f"near{i}"] + params[f"bias{i}"]
    if spec.kind == "sage":
        z = z + own @ params[f"own{i}"]
    if i + 1 == spec.layers:
        return z, None
    keep = drop_mask(node, z.shape[1], spec.dropout, salt * spec.layers + i) if salt is not None and spec.dropout else np.ones((1, 1))
    y = kept = z * keep
    dev = unit = None
    if spec.norm:
        dev = np.sqrt(kept.var(axis=1, keepdims=True) + EPS)
        unit = (kept - kept.mean(axis=1, keepdims=True)) / dev
        y = unit * params[f"gain{i}"] + params[f"shift{i}"]
    return np.maximum(y, 0), (keep, unit, dev, y)


def layer_back(spec: Spec, params: Params, i: int, own: np.ndarray, near: np.ndarray, known: tuple | None, g: np.ndarray) -> tuple[Params, np.ndarray, np.ndarray]:
    """Gradients of the layer's parameters, its own rows and its neighbours' sums, from ``g``, that of its output."""
    grads: Params = {}
    if known is not None:
        keep, unit, dev, y = known
        g = g * (y > 0)
        if spec.norm:
            grads[f"gain{i}"], grads[f"shift{i}"] = (g * unit).sum(axis=0), g.sum(axis=0)
            g = g * params[f"gain{i}"]
            g = (g - g.mean(axis=1, keepdims=True) - unit * (g * unit).mean(axis=1, keepdims=True)) / dev
        g = g * keep
    grads[f"near{i}"], grads[f"bias{i}"] = near.T @ g, g.sum(axis=0)
    if spec.kind == "sage":
        grads[f"own{i}"] = own.T @ g
    return grads, g @ params[f"own{i}"].T if spec.kind == "sage" else np.zeros_like(near), g @ params[f"near{i}"].T


def log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, width)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(m).ravel()), m.shape[1]).cast(pa.list_(pa.float64()))


def _flat(grads: Params, like: Params, loss: float, n: int) -> bytes:
    return np.concatenate([[loss, n], *(grads.get(k, np.zeros_like(v)).ravel() for k, v in like.items())]).tobytes()


def _summed(partials: DataFrame, like: Params) -> tuple[float, int, Params]:
    """Loss, rows and gradients over all tasks: summed in groups by tasks, then the groups by the driver."""

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x) for x in table.column("partial").to_pylist()], axis=0)
        return pa.table({"partial": pa.array([total.tobytes()], pa.binary())})

    groups = partials.groupBy(F.pmod(F.xxhash64("partial"), F.lit(_GROUPS)).alias("g")).applyInArrow(add, "partial binary")
    total = np.zeros(2 + sum(v.size for v in like.values()))
    for r in groups.collect():  # _GROUPS rows of the model's size at most
        total += np.frombuffer(r["partial"])
    out, at = {}, 2
    for k, v in like.items():
        out[k] = total[at : at + v.size].reshape(v.shape)
        at += v.size
    return float(total[0]), int(total[1]), out


def _forward(spec: Spec, params: Params, sums: Sums, nodes: DataFrame, first: DataFrame, salt: int | None) -> list[DataFrame]:
    """For each layer a written table (node_id, own, near) of what it takes in."""
    tables, rows = [], first
    for i in range(spec.layers):
        width = spec.into(i)
        near = agg.dense(nodes, sums.forward(rows, width, salt is not None), width).withColumnRenamed("feat", "near")
        own = F.col("feat").cast("array<double>") if spec.kind == "sage" else F.array().cast("array<double>")
        tables.append(settle(rows.select("node_id", own.alias("own")).join(near, "node_id"), "layer"))
        if i + 1 < spec.layers:
            rows = _outputs(spec, params, tables[-1], i, salt)
    return tables


def _outputs(spec: Spec, params: Params, table: DataFrame, i: int, salt: int | None) -> DataFrame:
    """(node_id, feat): the layer's output; of the last one, log probabilities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                node, own, near = _parts(spec, i, b)
                out, known = layer(spec, params, i, node, own, near, salt)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(out if known is not None else log_softmax(out))], names=["node_id", "feat"])

    return table.select("node_id", "own", "near").mapInArrow(run, "node_id long, feat array<double>")


def _parts(spec: Spec, i: int, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    near = _matrix(b.column(2), spec.into(i))
    return b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), spec.into(i)) if spec.kind == "sage" else near, near


def _backward(spec: Spec, params: Params, table: DataFrame, i: int, salt: int | None, scale: float) -> DataFrame:
    """A written table of rows (node_id, own, near), the gradients of what the layer takes in, and of partial sums (partial).

    ``table`` has, beside the inputs, ``g``: the gradient of the layer's output or,
    for the last layer, ``label``: the class, null where the row is not learnt from.
    """
    last = i + 1 == spec.layers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = {k: np.zeros_like(v) for k, v in params.items() if k[-1:] == str(i) and k.rstrip("0123456789") + str(i) == k}, 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            node, own, near = _parts(spec, i, b)
            out, known = layer(spec, params, i, node, own, near, salt)
            if last:
                logp, y = log_softmax(out), b.column(3).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                some = np.flatnonzero(y >= 0)
                g = np.zeros_like(out)
                g[some] = np.exp(logp[some])
                g[some, y[some]] -= 1
                g /= scale
                loss, n = loss - float(logp[some, y[some]].sum()), n + len(some)
            else:
                g = _matrix(b.column(3), out.shape[1])
            grads, d_own, d_near = layer_back(spec, params, i, own, near, known, g)
            for k, v in grads.items():
                total[k] += v
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(d_own), _lists(d_near), pa.nulls(b.num_rows, pa.binary())], names=["node_id", "own", "near", "partial"])
        empty = pa.nulls(1, pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), empty, empty, pa.array([_flat(total, params, loss, n)], pa.binary())], names=["node_id", "own", "near", "partial"])

    return settle(table.select("node_id", "own", "near", "label" if last else "g").mapInArrow(run, "node_id long, own array<double>, near array<double>, partial binary"), "back")


def _pulled(spec: Spec, sums: Sums, back: DataFrame, width: int) -> DataFrame:
    """(node_id, g): the gradient of a layer's input rows, from their own part and, along the edges turned round, their neighbours'."""
    rows = back.where("partial IS NULL")
    far = sums.back(rows.select("node_id", F.col("near").alias("feat")), width, True)
    if spec.kind != "sage":
        return agg.dense(rows, far, width).withColumnRenamed("feat", "g")
    both = rows.select("node_id", "own").join(far, "node_id", "left")
    return both.select("node_id", F.when(F.col("feat").isNull(), F.col("own")).otherwise(d.add_rows(F.col("own"), F.col("feat"))).alias("g"))


def _with_labels(spec: Spec, params: Params, nodes: DataFrame, marked: Column) -> DataFrame:
    """The input rows, with label embeddings on the marked ones."""
    rows = nodes.select("node_id", "feat")
    if not spec.label_rate:
        return rows
    return d.label_rows(rows, nodes.where(marked & (F.col("label") >= 0)).select("node_id", "label"), params["labels"], bool(spec.label_width))


def _marks(spec: Spec, epoch: int) -> tuple[Column, Column]:
    """Train nodes whose labels are input in this epoch, and those that are learnt from."""
    train = F.col("split") == "train"
    shown = train & (share(F.col("node_id"), epoch) < spec.label_rate)
    return shown, train & ~shown


def loss_and_gradients(spec: Spec, params: Params, sums: Sums, nodes: DataFrame, epoch: int = 0, count: int | None = None) -> tuple[float, Params]:
    """The training loss and its gradient in every parameter.

    ``nodes`` has (node_id, feat, label, split). The loss is the summed NLL of the
    learnt rows over the train nodes' number times one less the label rate (Q20).
    """
    shown, learnt = _marks(spec, epoch)
    count = count if count is not None else nodes.where("split = 'train'").count()
    scale = max(count, 1) * (1 - spec.label_rate)
    tables = _forward(spec, params, sums, nodes, _with_labels(spec, params, nodes, shown), epoch)
    labels = nodes.select("node_id", F.when(learnt & F.col("label").between(0, spec.widths[-1] - 1), F.col("label")).cast("long").alias("label"))
    total, loss, pulled, backs = {k: np.zeros_like(v) for k, v in params.items()}, 0.0, None, []
    for i in range(spec.layers - 1, -1, -1):
        table = tables[i].join(labels if pulled is None else pulled, "node_id")
        backs.append(_backward(spec, params, table, i, epoch, scale))
        part, _, grads = _summed(backs[-1].where("partial IS NOT NULL").select("partial"), params)
        loss += part
        for k, v in grads.items():
            total[k] += v
        if i or spec.label_rate:
            pulled = _pulled(spec, sums, backs[-1], spec.into(i))
    if spec.label_rate:
        width = spec.into(0)
        by_class = agg.reduced(pulled.join(nodes.where(shown & (F.col("label") >= 0)).select("node_id", "label"), "node_id"), ["label"], "g", width)
        for r in by_class.collect():  # a row a class
            total["labels"][r["label"]] += np.array(r["feat"][spec.widths[0] if spec.label_width else 0 :])
    discard(*tables, *backs)
    return loss / scale, total


def input_gradient(spec: Spec, params: Params, sums: Sums, nodes: DataFrame) -> DataFrame:
    """(node_id, g): the loss's gradient in the input rows of a model of one layer."""
    if spec.layers != 1:
        raise ValueError("of one layer")
    scale = max(nodes.where("split = 'train'").count(), 1)
    table = _forward(spec, params, sums, nodes, nodes.select("node_id", "feat"), None)[0]
    labels = nodes.select("node_id", F.when(F.col("split") == "train", F.col("label")).cast("long").alias("label"))
    return _pulled(spec, sums, _backward(spec, params, table.join(labels, "node_id"), 0, None, scale), spec.into(0))


def predict(spec: Spec, params: Params, sums: Sums, nodes: DataFrame) -> DataFrame:
    """(node_id, feat): log probabilities without dropout, the labels of all train nodes shown where the model takes labels."""
    tables = _forward(spec, params, sums, nodes, _with_labels(spec, params, nodes, F.col("split") == "train"), None)
    out = settle(_outputs(spec, params, tables[-1], spec.layers - 1, None), "predicted")
    discard(*tables)
    return out


HISTORY = "epoch int, train_loss double, valid_loss double, train_acc double, valid_acc double, test_acc double, seconds double"


@dataclass(frozen=True)
class Fit:
    params: Params
    history: list[tuple]
    best_epoch: int
    best_test: float
    final: dict[str, float]  # accuracies of the best epoch's parameters


def _judge(logp: DataFrame, labels: DataFrame) -> tuple[float, dict[str, float]]:
    got = {r["split"]: r for r in model.accuracy(logp, labels).collect()}  # a row a split
    return got["valid"]["loss"] if "valid" in got else float("inf"), {s: got[s]["correct"] / got[s]["total"] if s in got else 0.0 for s in ("train", "valid", "test")}


def descend(params: Params, groups: Callable[[str], tuple[float, float]], step: Callable[[Params, int], tuple[float, Params]], judge: Callable[[Params], tuple[float, dict[str, float]]], epochs: int, patience: int | None, save: Callable[[Params], None] | None = None, restore: Callable[[], Params] | None = None) -> Fit:
    """Epochs of ``step`` and Adam; the parameters of the least validation loss are kept, saved, and judged at the end."""
    names = list(params)
    opt = model.Adam(*map(list, zip(*(groups(k) for k in names), strict=True)))
    history, best, kept, top = [], (float("inf"), -1), {k: v.copy() for k, v in params.items()}, 0.0
    for epoch in range(epochs):
        began = time.perf_counter()
        loss, grads = step(params, epoch)
        opt.step([params[k] for k in names], [grads[k] for k in names])
        took = time.perf_counter() - began
        valid, acc = judge(params)
        history.append((epoch, loss, valid, acc["train"], acc["valid"], acc["test"], took))
        top = max(top, acc["test"])
        if valid < best[0]:
            best, kept = (valid, epoch), {k: v.copy() for k, v in params.items()}
            if save:
                save(kept)
        elif patience and epoch - best[1] >= patience:
            break
    kept = restore() if restore and best[1] >= 0 else kept
    return Fit(kept, history, best[1], top, judge(kept)[1])


def _checkpoint(spark, path: str | None, like: Params) -> tuple[Callable | None, Callable | None]:
    if path is None:
        return None, None
    names = list(like)

    def restore() -> Params:
        found = model.load_weights(spark, path)
        return {k: found[k][0].reshape(like[k].shape) for k in names}

    return lambda p: model.save_weights(spark, path, {k: [p[k]] for k in names}), restore


def fit(spec: Spec, sums: Sums, nodes: DataFrame, epochs: int, rate: float = 0.01, decay: float = 0.0, patience: int | None = None, seed: int = 0, checkpoint: str | None = None) -> Fit:
    """Train SAGE or GCN on ``nodes`` (node_id, feat, label, split); ``checkpoint`` is a path for the best parameters."""
    params = init(spec, seed)
    labels = nodes.select("node_id", "label", "split")
    count = nodes.where("split = 'train'").count()

    def judge(p: Params) -> tuple[float, dict[str, float]]:
        logp = predict(spec, p, sums, nodes)
        out = _judge(logp, labels)
        discard(logp)
        return out

    save, restore = _checkpoint(nodes.sparkSession, checkpoint, params)
    return descend(params, lambda _: (rate, decay), lambda p, epoch: loss_and_gradients(spec, p, sums, nodes, epoch, count), judge, epochs, patience, save, restore)


# Models of pre-propagated rows


def hop_inputs(edges: DataFrame, nodes: DataFrame, width: int, hops: int) -> DataFrame:
    """(node_id, x0..., label, split): rows as they are, and after 1..hops normalised sums without and with self loops, in turn; written."""
    feats, kinds = nodes.select("node_id", "feat"), []
    for e in (edges, unit_loops(edges, nodes)):
        kinds.append(agg.k_hop(symmetric(e, nodes), feats, nodes, width, hops, "w"))
    out, k = nodes.select("node_id", F.col("feat").cast("array<double>").alias("x0"), "label", "split"), 0
    for pair in zip(*kinds, strict=True):
        for rows in pair:
            k += 1
            out = out.join(rows.withColumnRenamed("feat", f"x{k}"), "node_id")
    made = settle(out, "hops")
    discard(*kinds[0], *kinds[1])
    return made


@dataclass(frozen=True)
class HopSpec:
    """``inputs`` tables of ``into`` columns, each mapped to ``hidden``, L2-normalised on request, weighed by softmax(attention), joined or summed, relu, dropout, mapped to ``classes``."""

    inputs: int
    into: int
    hidden: int
    classes: int
    how: str = "concat"
    normalise: bool = True
    dropout: float = 0.0


def init_hops(spec: HopSpec, seed: int = 0) -> Params:
    rng, out = np.random.default_rng(seed), {}
    for i in range(spec.inputs):
        out[f"in{i}"], out[f"inbias{i}"] = model.glorot(rng, spec.into, spec.hidden), np.zeros(spec.hidden)
    wide = spec.hidden * (spec.inputs if spec.how == "concat" else 1)
    return out | {"att": np.ones(spec.inputs), "out": model.glorot(rng, wide, spec.classes), "outbias": np.zeros(spec.classes)}


def hops_forward(spec: HopSpec, params: Params, node: np.ndarray, xs: list[np.ndarray], salt: int | None) -> tuple[np.ndarray, tuple]:
    part = np.exp(params["att"] - params["att"].max())
    part = part / part.sum()
    images = [x @ params[f"in{i}"] + params[f"inbias{i}"] for i, x in enumerate(xs)]
    sizes = [np.maximum(np.sqrt((t * t).sum(axis=1, keepdims=True)), 1e-12) if spec.normalise else np.ones((len(t), 1)) for t in images]
    units = [t / s for t, s in zip(images, sizes, strict=True)]
    scaled = [p * u for p, u in zip(part, units, strict=True)]
    whole = np.concatenate(scaled, axis=1) if spec.how == "concat" else np.sum(scaled, axis=0)
    keep = drop_mask(node, whole.shape[1], spec.dropout, salt) if salt is not None and spec.dropout else np.ones((1, 1))
    kept = np.maximum(whole, 0) * keep
    return log_softmax(kept @ params["out"] + params["outbias"]), (part, sizes, units, whole, keep, kept)


def hops_back(spec: HopSpec, params: Params, xs: list[np.ndarray], known: tuple, g: np.ndarray) -> Params:
    part, sizes, units, whole, keep, kept = known
    grads = {"out": kept.T @ g, "outbias": g.sum(axis=0)}
    g = (g @ params["out"].T) * keep * (whole > 0)
    d_part = np.zeros(spec.inputs)
    for i, x in enumerate(xs):
        mine = g[:, i * spec.hidden : (i + 1) * spec.hidden] if spec.how == "concat" else g
        d_part[i] = (mine * units[i]).sum()
        mine = mine * part[i]
        if spec.normalise:
            mine = (mine - units[i] * (mine * units[i]).sum(axis=1, keepdims=True)) / sizes[i]
        grads[f"in{i}"], grads[f"inbias{i}"] = x.T @ mine, mine.sum(axis=0)
    grads["att"] = part * (d_part - (part * d_part).sum())
    return grads


def _hop_rows(spec: HopSpec, b: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    return b.column(0).to_numpy(zero_copy_only=False), [_matrix(b.column(1 + i), spec.into) for i in range(spec.inputs)]


def hops_gradients(spec: HopSpec, params: Params, rows: DataFrame, epoch: int = 0) -> tuple[float, Params]:
    """The mean NLL of the train rows and its gradient in every parameter; rows are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = {k: np.zeros_like(v) for k, v in params.items()}, 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            node, xs = _hop_rows(spec, b)
            y = b.column(1 + spec.inputs).to_numpy(zero_copy_only=False).astype(np.int64)
            logp, known = hops_forward(spec, params, node, xs, epoch)
            at = np.arange(len(y))
            loss, n = loss - float(logp[at, y].sum()), n + len(y)
            g = np.exp(logp)
            g[at, y] -= 1
            for k, v in hops_back(spec, params, xs, known, g).items():
                total[k] += v
        yield pa.RecordBatch.from_arrays([pa.array([_flat(total, params, loss, n)], pa.binary())], names=["partial"])

    learnt = rows.where((F.col("split") == "train") & F.col("label").between(0, spec.classes - 1))
    partials = learnt.select("node_id", *[f"x{i}" for i in range(spec.inputs)], F.col("label").cast("long")).mapInArrow(run, "partial binary")
    loss, n, grads = _summed(partials, params)
    return loss / max(n, 1), {k: v / max(n, 1) for k, v in grads.items()}


def predict_hops(spec: HopSpec, params: Params, rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(hops_forward(spec, params, *_hop_rows(spec, b), None)[0])], names=["node_id", "feat"])

    return rows.select("node_id", *[f"x{i}" for i in range(spec.inputs)]).mapInArrow(run, "node_id long, feat array<double>")


def fit_hops(spec: HopSpec, rows: DataFrame, epochs: int, rate: float = 0.02, att_rate: float = 0.02, out_decay: float = 0.0005, in_decay: float = 0.0005, att_decay: float = 0.0005, patience: int | None = 100, seed: int = 0, checkpoint: str | None = None) -> Fit:
    """Train on ``hop_inputs`` rows, with a rate and a decay for each group: output, inputs, attention."""
    params = init_hops(spec, seed)
    labels = rows.select("node_id", "label", "split")
    groups = lambda k: (att_rate, att_decay) if k == "att" else (rate, out_decay if k.startswith("out") else in_decay)
    save, restore = _checkpoint(rows.sparkSession, checkpoint, params)
    return descend(params, groups, lambda p, epoch: hops_gradients(spec, p, rows, epoch), lambda p: _judge(predict_hops(spec, p, rows), labels), epochs, patience, save, restore)
