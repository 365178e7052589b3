"""Edge and feature normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.operators.prep import in_degree


def unit_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w) with the diagonal set to one (I12); other weights are one where there are none."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    return edges.where("src <> dst").select("src", "dst", w.cast("double").alias("w")).union(nodes.select("node_id", "node_id", F.lit(1.0)))


def symmetric(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w): weights times deg(src)^-1/2 deg(dst)^-1/2, degrees counting entries (I11, E8, Q26); zero for degree zero."""
    scale = in_degree(nodes, edges).select("node_id", F.when(F.col("deg") > 0, F.pow("deg", F.lit(-0.5))).otherwise(F.lit(0.0)).alias("s"))
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    e = edges.select("src", "dst", w.alias("w"))
    e = e.join(scale.select(F.col("node_id").alias("src"), F.col("s").alias("a")), "src")
    return e.join(scale.select(F.col("node_id").alias("dst"), F.col("s").alias("b")), "dst").select("src", "dst", (F.col("w") * F.col("a") * F.col("b")).alias("w"))


def by_degree(rows: DataFrame, degrees: DataFrame) -> DataFrame:
    """Features over max(degree, 1) (L4)."""
    d = degrees.select("node_id", F.greatest("deg", F.lit(1)).alias("deg"))
    return rows.join(d, "node_id").select("node_id", F.transform("feat", lambda x: x / F.col("deg")).alias("feat"))


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _doubles(feat: Column) -> Column:
    return F.transform(feat, lambda v: v.cast("double"))


def l2(feat: Column) -> Column:
    """A row over its length, which counts as 1e-12 at least."""
    return bind(_doubles(feat), lambda x: bind(F.greatest(F.sqrt(_total(F.transform(x, lambda v: v * v))), F.lit(1e-12)), lambda norm: F.transform(x, lambda v: v / norm)))


def layer_norm(feat: Column, width: int, eps: float = 1e-5, gain: list[float] | None = None, bias: list[float] | None = None) -> Column:
    """Biased variance, eps 1e-5, affine if given."""

    def scaled(x: Column) -> Column:
        return bind(F.sqrt(_total(F.transform(x, lambda v: v * v)) / width + eps), lambda dev: F.transform(x, lambda v: v / dev))

    centred = bind(_doubles(feat), lambda x: bind(_total(x) / width, lambda mean: F.transform(x, lambda v: v - mean)))
    out = bind(centred, scaled)
    if gain is not None:
        out = F.zip_with(out, F.array(*map(F.lit, gain)), lambda a, b: a * b)
    if bias is not None:
        out = F.zip_with(out, F.array(*map(F.lit, bias)), lambda a, b: a + b)
    return out


def batch_norm(rows: DataFrame, width: int, local: bool = True, eps: float = 1e-5) -> DataFrame:
    """Columns less their mean over their deviation (L7, F16): ``local`` has the unbiased one without eps, else sqrt(E[x^2] - E[x]^2 + eps).

    The statistics are one row; a column without spread gives null.
    """
    cells = [F.get("feat", F.lit(j)).cast("double") for j in range(width)]
    means = F.array(*[F.avg(c) for c in cells]).alias("mean")
    if local:
        spread = F.array(*[F.stddev_samp(c) for c in cells])
    else:
        spread = F.array(*[F.sqrt(F.avg(c * c) - F.avg(c) * F.avg(c) + eps) for c in cells])
    stats = rows.agg(means, spread.alias("dev"))
    centred = F.zip_with("feat", "mean", lambda x, m: x.cast("double") - m)
    return rows.crossJoin(F.broadcast(stats)).select("node_id", F.zip_with(centred, F.col("dev"), lambda x, d: F.try_divide(x, d)).alias("feat"))


def moments(rows: DataFrame, width: int) -> DataFrame:
    """(j, mean, square): column means and means of squares (F16)."""
    long = rows.select(F.posexplode("feat").alias("j", "v")).select("j", F.col("v").cast("double").alias("v"))
    return long.groupBy("j").agg(F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("square"))
