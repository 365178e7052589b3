"""Sampling and work splitting as queries (M1-M4, N1-N4, C9). Draws are congruences of ids: the same every time, on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.functions.quantise import scatter, share
from shardweave.operators.running import running


def thin(mask: Column, node: Column, ratio: float, salt: int = 0) -> Column:
    """A mask kept at about ``ratio`` of its rows (M1)."""
    return mask & (share(node, salt) < ratio)


def supervision(train: Column, propagated: Column) -> Column:
    """Trained on but not propagated."""
    return train & ~propagated


def multinomial(node: Column, weights: dict[str, float], salt: int = 0) -> Column:
    """One of ``weights`` for each row, with replacement (M2)."""
    u, total, at, pick = share(node, salt), sum(weights.values()), 0.0, F
    for value, w in weights.items():
        at += w / total
        pick = pick.when(u < at, value)
    return pick.otherwise(list(weights)[-1])


def choose(rows: DataFrame, key: str, k: int, salt: int = 0) -> DataFrame:
    """``k`` rows without replacement (M3): those of the least draws; each task keeps k rows at most."""
    return rows.orderBy(share(F.col(key), salt), key).limit(k)


def choose_weighted(rows: DataFrame, key: str, weight: str, k: int, salt: int = 0) -> DataFrame:
    """``k`` rows without replacement in proportion to a weight (M3): least -ln(u) / weight."""
    u = 1 - share(F.col(key), salt)  # in (0, 1]
    return rows.where(F.col(weight) > 0).orderBy(F.round(-F.ln(u) / F.col(weight), 12), key).limit(k)


def split_rows(flops: DataFrame, workers: int) -> DataFrame:
    """(node_id, worker): contiguous rows dealt so that each worker has about the same flops."""
    from shardweave.operators.partition import assign_balanced

    return assign_balanced(flops.select("node_id", (F.col("flops") - 1).alias("w")), workers, "w").withColumnRenamed("part", "worker")


def split_even(n: int, workers: int, unit: int = 1) -> list[tuple[int, int]]:
    """Ranges of ceil(n / workers), in whole units (N2-N4); the last ones may be empty."""
    size = -(-(-(-n // workers)) // unit) * unit
    return [(min(n, i * size), min(n, (i + 1) * size)) for i in range(workers)]


def rank_blocks(rows: DataFrame, rank: str, unit: int, workers: int) -> DataFrame:
    """(rank, node_id, worker): rows of a rank dealt in whole packing units, no unit across ranks."""
    sizes = rows.groupBy(rank).agg((F.ceil(F.ceil(F.count(F.lit(1)) / workers) / unit) * unit).alias("__size"))
    placed = running(rows.select(rank, "node_id"), [rank], ["node_id"], name="__k").join(sizes, rank)
    return placed.select(rank, "node_id", F.floor(F.col("__k") / F.col("__size")).cast("long").alias("worker"))


def gaussian(rows: DataFrame, node: str, width: int, seed: int = 0) -> DataFrame:
    """(node_id, feat): normal features (M4, A7) by the Box-Muller transform of two draws a cell; width 500,000,000 at most."""
    u = lambda j, s: (scatter(scatter(F.col(node)) + j * 2 + (seed * 1000003 + s)) + 1) / float(1 << 31)
    cell = lambda j: F.sqrt(-2 * F.ln(u(j, 0))) * F.cos(2 * 3.141592653589793 * u(j, 1))
    return rows.select(F.col(node).alias("node_id"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: cell(j).cast("float")).alias("feat"))
