"""Minimum vertex covers of bipartite cut graphs (I1-I9, J3): matching by phases of shortest paths, cover by alternating reach."""

from __future__ import annotations

from array import array
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.operators.components import components


def matching(adjacent: dict[int, array]) -> dict[int, int]:
    """A maximum matching, left to right; ``adjacent`` has the right neighbours of every left node. No recursion."""
    left: dict[int, int] = {}
    right: dict[int, int] = {}
    while True:
        level, queue = {u: 0 for u in adjacent if u not in left}, deque(u for u in adjacent if u not in left)
        found = False
        while queue:
            u = queue.popleft()
            for v in adjacent[u]:
                w = right.get(v)
                if w is None:
                    found = True
                elif w not in level:
                    level[w] = level[u] + 1
                    queue.append(w)
        if not found:
            return left
        rest = {u: iter(vs) for u, vs in adjacent.items()}
        for root in [u for u in adjacent if u not in left]:
            path = [(root, -1)]  # left nodes with the right node that leads to them
            while path:
                u = path[-1][0]
                v = next((v for v in rest[u] if v not in right or level.get(right[v]) == level[u] + 1), None)
                if v is None:
                    level.pop(u, None)
                    path.pop()
                elif v in right:
                    path.append((right[v], v))
                else:
                    for w, before in reversed(path):
                        left[w], right[v], v = v, w, before
                    break


def vertex_cover(edges: list[tuple[int, int]] | np.ndarray) -> tuple[set[int], set[int]]:
    """Left and right nodes of a minimum cover; its size is that of a maximum matching. Neighbours take eight bytes an edge."""
    pairs = np.asarray(edges, np.int64).reshape(-1, 2)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    starts = np.flatnonzero(np.diff(pairs[:, 0], prepend=pairs[0, 0] - 1)).tolist() if len(pairs) else []
    adjacent = {int(pairs[s, 0]): array("q", np.unique(pairs[s:e, 1]).tobytes()) for s, e in zip(starts, [*starts[1:], len(pairs)], strict=True)}
    left = matching(adjacent)
    right = {v: u for u, v in left.items()}
    seen_left = {u for u in adjacent if u not in left}
    seen_right: set[int] = set()
    queue = deque(seen_left)
    while queue:
        for v in adjacent[queue.popleft()]:
            if v not in seen_right:
                seen_right.add(v)
                w = right[v]  # else the matching would not be maximum
                if w not in seen_left:
                    seen_left.add(w)
                    queue.append(w)
    return set(adjacent) - seen_left, seen_right


def covers(cut: DataFrame, max_edges: int = 200_000) -> DataFrame:
    """(src_part, dst_part, side, node): a minimum cover of each part pair's cut edges.

    A pair with more than ``max_edges`` edges is split into its connected
    components, whose covers make up the pair's. No component is left out: one
    beyond that is still covered whole, by one task that holds its edges.
    """
    cut = cut.select("src_part", "dst_part", "src", "dst").distinct()
    sizes = cut.groupBy("src_part", "dst_part").agg(F.count(F.lit(1)).alias("n"))
    sized = cut.join(sizes, ["src_part", "dst_part"])
    small = sized.where(F.col("n") <= max_edges).withColumn("group", F.lit(0).cast("long"))
    rows = small
    large = sized.where(F.col("n") > max_edges)
    if not large.isEmpty():
        left = F.xxhash64("src_part", "dst_part", F.lit("l"), "src")
        ends = large.select("*", left.alias("l"), F.xxhash64("src_part", "dst_part", F.lit("r"), "dst").alias("r"))
        label = components(ends, "l", "r").select(F.col("node").alias("l"), F.col("component").alias("group"))
        parts = ends.join(label, "l").drop("l", "r", "n")
        rows = rows.drop("n").unionByName(parts)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = vertex_cover(pdf[["src", "dst"]].to_numpy(np.int64))
        out = [(key[0], key[1], "src", n) for n in sorted(left)] + [(key[0], key[1], "dst", n) for n in sorted(right)]
        return pd.DataFrame(out, columns=["src_part", "dst_part", "side", "node"]).astype({"src_part": "int64", "dst_part": "int64", "node": "int64"})

    return rows.groupBy("src_part", "dst_part", "group").applyInPandas(one, "src_part long, dst_part long, side string, node long")
