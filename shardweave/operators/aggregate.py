"""Neighbourhood aggregation: edges joined with features, reduced by dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.runtime import discard, settle

#: Up to this width a row of sums is one aggregate over an array; beyond, rows are (node, j, value).
WIDE = 256
REDUCES = ("sum", "mean", "min", "max", "mul", "div")


def _reduce(v: Column, how: str) -> Column:
    if how == "div":  # one over the product; a zero factor gives null
        return F.try_divide(F.lit(1.0), F.product(v))
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "mul": F.product}[how](v)


def gathered(edges: DataFrame, feats: DataFrame, key: str = "src") -> DataFrame:
    """Edges with the feature row of their ``key`` end, as ``x`` (E4); the smaller side is broadcast only if Spark measures it as small."""
    return edges.join(feats.select(F.col("node_id").alias(key), F.col("feat").alias("x")), key)


def aggregate(edges: DataFrame, feats: DataFrame, width: int, reduce: str = "sum", weight: str | None = None, by: str = "dst") -> DataFrame:
    """(node_id, feat): per ``by`` end the reduction of the other end's features, times the edge weight if given (F6, F7; F10 with by="src").

    Values are doubles. Partial sums are made before the shuffle, so it moves a
    row for each key and task at most. Nodes without edges are absent; ``dense``
    adds them.
    """
    if reduce not in REDUCES:
        raise ValueError(f"reduce: one of {REDUCES}")
    rows = gathered(edges, feats, "src" if by == "dst" else "dst")
    w = F.col(weight) if weight else F.lit(1.0)
    return reduced(rows.select(F.col(by).alias("node_id"), "x", *([w.alias("w")] if weight else [])), ["node_id"], "x", width, reduce, "w" if weight else None)


def reduced(rows: DataFrame, by: list[str], x: str, width: int, reduce: str = "sum", weight: str | None = None) -> DataFrame:
    """(by, feat): the reduction of the arrays ``x`` place by place, over any number of rows."""
    if width <= WIDE:
        cells = [F.get(x, F.lit(j)).cast("double") for j in range(width)]
        cells = [_reduce(c * F.col(weight) if weight else c, reduce).alias(f"c{j}") for j, c in enumerate(cells)]
        return rows.groupBy(*by).agg(*cells).select(*by, F.array(*[f"c{j}" for j in range(width)]).alias("feat"))
    long = rows.select(*by, F.posexplode(x).alias("j", "v"), (F.col(weight) if weight else F.lit(1.0)).alias("__w"))
    cell = long.groupBy(*by, "j").agg(_reduce(F.col("v").cast("double") * F.col("__w"), reduce).alias("v"))
    return cell.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("j", "v"))).alias("c")).select(*by, F.col("c.v").alias("feat"))


def dense(nodes: DataFrame, rows: DataFrame, width: int, fill: float = 0.0) -> DataFrame:
    """A row for every node, ``fill`` where nothing was aggregated (0 for sum, mean, min and max; 1 for mul and div)."""
    empty = F.array_repeat(F.lit(fill), width)
    return nodes.select("node_id").join(rows, "node_id", "left").select("node_id", F.coalesce("feat", empty).alias("feat"))


def arg_reduce(edges: DataFrame, feats: DataFrame, j: int, most: bool) -> DataFrame:
    """(node_id, eid): the edge that gives column ``j`` its minimum or maximum (F6); ties go to the smallest eid."""
    v = F.get("x", F.lit(j)).cast("double")
    pick = F.min(F.struct((-v if most else v).alias("v"), "eid"))
    return gathered(edges, feats).groupBy(F.col("dst").alias("node_id")).agg(pick.alias("p")).select("node_id", F.col("p.eid").alias("eid"))


def add(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Sum by node of two (node_id, feat) tables, with any number of rows a node (F11, Q1); nodes of either stay."""
    return reduced(a.unionByName(b), ["node_id"], "feat", width)


def sampled_products(edges: DataFrame, feats: DataFrame, grads: DataFrame, mean: bool = False) -> DataFrame:
    """(src, dst, v): per edge the inner product of src's features and dst's gradient (F12), over the in-degree for means."""
    rows = gathered(edges.select("src", "dst"), feats).join(grads.select(F.col("node_id").alias("dst"), F.col("feat").alias("g")), "dst")
    dot = F.aggregate(F.zip_with("x", "g", lambda x, g: x.cast("double") * g.cast("double")), F.lit(0.0), lambda s, v: s + v)
    out = rows.select("src", "dst", dot.alias("v"))
    if mean:
        deg = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("d"))
        out = out.join(deg, "dst").select("src", "dst", (F.col("v") / F.col("d")).alias("v"))
    return out


def flops(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(node_id, flops): entries, or their weight, of each row."""
    return edges.groupBy(F.col("dst").alias("node_id")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("flops"))


def k_hop(edges: DataFrame, feats: DataFrame, nodes: DataFrame, width: int, hops: int, weight: str | None = None) -> list[DataFrame]:
    """Features after 1..hops aggregations (I10); each hop is a written table, so lineage doesn't grow. Edges are written once, as often as they are read."""
    out, now = [], feats
    if hops > 1:
        edges = settle(edges.select("src", "dst", *([weight] if weight else [])), "hop-edges")
    for _ in range(hops):
        now = settle(dense(nodes, aggregate(edges, now, width, "sum", weight), width), "hop")
        out.append(now)
    discard(edges)
    return out
