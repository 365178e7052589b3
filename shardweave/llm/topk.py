"""Exact top-k search (5): block-at-a-time pruning over block forward indexes.

Vectors become integer term weights, floor(scale * x). Ranges of vec_id make up
blocks; a block's forward index is its weights as a dense matrix, with the
maximum and the minimum of each term. For a query, a block's bound is the sum
over terms of the larger of weight times maximum and weight times minimum
(weights may be negative).

1. Bounds come from the maxima alone, which are a five-hundredth of the vectors:
   chunks of queries meet runs of blocks.
2. Each query is scored against the block of its greatest bound; the k-th score
   there is a threshold that no result falls below.
3. Only blocks whose bound reaches the threshold of some query of a chunk are
   sent to it. There each query takes blocks in descending bound, scored whole,
   until the bound falls below its k-th score so far, which starts from the
   threshold.

Every meeting is a group by key of bounded size, never a cross join, and each
query keeps k rows a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardweave.runtime import settle

_INDEX = "name string, at long, ids binary, weights binary, most binary, least binary"


def _weights(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, w): rows whose vector is whole and finite, as integers."""
    x = F.col("embedding")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("w"))


def _forward(weights: DataFrame, width: int, rows: int, name: str) -> DataFrame:
    """Forward indexes of consecutive vec_ids, at most ``rows`` vectors each, numbered in column ``name``; shorter vectors count as padded with zeros."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                m = np.zeros((part.num_rows, width), "<i8")
                w = part.column(1)
                sizes = w.value_lengths().to_numpy(zero_copy_only=False)
                m[np.arange(width)[None, :] < sizes[:, None]] = w.flatten().to_numpy(zero_copy_only=False)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                cols = [[f"{ids[0]}-{ids[-1]}-{i}"], [int(ids[0])], [ids.tobytes()], [m.tobytes()], [m.max(axis=0).tobytes()], [m.min(axis=0).tobytes()]]
                types = [pa.string(), pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["name", "at", "ids", "weights", "most", "least"])

    made = settle(weights.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(build, _INDEX), "forward")
    numbers = made.select("name", (F.row_number().over(Window.orderBy("at", "name")) - 1).cast("long").alias(name))  # a row a block: no vectors
    return settle(made.join(numbers, "name").drop("name", "at"), "numbered")


def _kind(a: np.ndarray, b: np.ndarray, width: int) -> type:
    """Doubles where all sums are exact in them, else 64-bit integers, else integers of any size."""
    most = lambda m: int(max(abs(int(m.max(initial=0))), abs(int(m.min(initial=0)))))
    top = most(a) * most(b) * width
    return np.float64 if top < 1 << 53 else np.int64 if top < 1 << 63 else object


def _ints(raw: bytes, width: int | None = None) -> np.ndarray:
    a = np.frombuffer(raw, "<i8")
    return a if width is None else a.reshape(-1, width)


def _bounds(q: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A row a query, a column a block."""
    kind = _kind(q, np.concatenate([most, least]), q.shape[1])
    q, most, least = (x.astype(kind) for x in (q, most, least))
    return np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T


def _best(q: np.ndarray, own: int, blocks: Iterator[tuple[object, np.ndarray, np.ndarray]], k: int, floor: int | None) -> list[tuple[int, int]]:
    """(score, vec_id) of a query's best rows, at most ``k``, of blocks (bound, ids, weights) in descending bound; none below ``floor``."""
    scores, found = np.zeros(0, object), np.zeros(0, np.int64)
    for bound, ids, weights in blocks:
        least = scores[-1] if len(scores) == k else floor
        if floor is not None and least is not None and floor > least:
            least = floor
        if least is not None and bound is not None and bound < least:
            break
        kind = _kind(q, weights, len(q))
        s = weights.astype(kind) @ q.astype(kind)
        ok = ids != own
        if least is not None:
            ok &= s >= least
        if not ok.any():
            continue
        both, who = np.concatenate((scores, np.array([int(x) for x in s[ok]], object))), np.concatenate((found, ids[ok]))
        top = sorted(range(len(both)), key=lambda i: (-both[i], who[i]))[:k]
        scores, found = both[top], who[top]
    return list(zip(scores.tolist(), found.tolist(), strict=True))


@dataclass(frozen=True)
class Search:
    """The parts of a search: numbered blocks and chunks, and which (chunk, no) meet after pruning."""

    index: DataFrame
    asked: DataFrame
    met: DataFrame
    width: int


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})


def _upto(n: int) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


def prune(vectors: DataFrame, every: int, k: int, scale: int, block: int, chunk: int, run: int = 1024) -> Search | None:
    """What has to meet: for each chunk of queries the blocks whose bound reaches the threshold of one of them. None without queries."""
    weights = settle(_weights(vectors, scale), "weights")
    width = max(1, weights.agg(F.max(F.size("w"))).first()[0] or 1)
    asked = _forward(weights.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), width, chunk, "chunk").select("chunk", "ids", "weights")
    chunks = asked.count()
    if not chunks:
        return None
    index = _forward(weights, width, block, "no")
    runs = -(-index.count() // run)
    edges = index.select(F.floor(F.col("no") / run).cast("long").alias("run"), "no", "most", "least", F.explode(_upto(chunks)).alias("chunk"))
    spread = lambda df: df.withColumn("run", F.explode(_upto(runs)))

    def maxima(many: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return many.column("no").to_numpy(), *(np.stack([_ints(x) for x in many.column(c).to_pylist()]) for c in ("most", "least"))

    def first(key: tuple, one: pa.Table, many: pa.Table) -> pa.Table:
        out = []
        if one.num_rows and many.num_rows:
            ids, q = _ints(one.column("ids")[0].as_py()), _ints(one.column("weights")[0].as_py(), width)
            no, most, least = maxima(many)
            bounds = _bounds(q, most, least)
            top = bounds.argmax(axis=1)
            out = [(key[0].as_py(), i, int(ids[i]), int(no[b]), float(bounds[i, b]), q[i].tobytes()) for i, b in enumerate(top.tolist())]
        return _rows(out, ["chunk", "place", "id", "no", "bound", "q"], [pa.int64()] * 4 + [pa.float64(), pa.binary()])

    leads = spread(asked).groupBy("chunk", "run").cogroup(edges.groupBy("chunk", "run")).applyInArrow(first, "chunk long, place long, id long, no long, bound double, q binary")
    lead = leads.groupBy("chunk", "place").agg(F.max_by(F.struct("id", "no", "q"), F.struct("bound", "no")).alias("x")).select("chunk", "place", "x.*")
    lead = settle(lead, "leads")
    parts = settle(lead.groupBy("no").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("long").alias("parts")), "parts")  # a block that leads for many queries is tried in several groups
    tried = lead.join(parts, "no").withColumn("part", F.pmod(F.xxhash64("chunk", "place"), F.col("parts"))).drop("parts")
    copies = index.select("no", "ids", "weights").join(parts, "no").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def threshold(key: tuple, queries: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows:
            ids, w = _ints(blocks.column("ids")[0].as_py()), _ints(blocks.column("weights")[0].as_py(), width)
            for c, p, own, raw in zip(*(queries.column(n).to_pylist() for n in ("chunk", "place", "id", "q")), strict=True):
                best = _best(_ints(raw), own, iter([(None, ids, w)]), k, None)
                if len(best) == k:
                    out.append((c, p, min(max(best[-1][0], -(1 << 63)), (1 << 63) - 1)))
        return _rows(out, ["chunk", "place", "least"], [pa.int64()] * 3)

    least = tried.groupBy("no", "part").cogroup(copies.groupBy("no", "part")).applyInArrow(threshold, "chunk long, place long, least long")
    least = least.groupBy("chunk").agg(F.collect_list(F.struct("place", "least")).alias("floors"))  # a chunk's queries
    asked = settle(asked.join(least, "chunk", "left"), "asked")

    def meet(key: tuple, one: pa.Table, many: pa.Table) -> pa.Table:
        out = []
        if one.num_rows and many.num_rows:
            no, most, least_ = maxima(many)
            bounds = _bounds(_ints(one.column("weights")[0].as_py(), width), most, least_)
            floors = _floors(one, len(bounds))
            ok = np.ones(bounds.shape, bool)
            for i, f in enumerate(floors):
                if f is not None:
                    ok[i] = bounds[i] >= f
            for b in np.flatnonzero(ok.any(axis=0)).tolist():
                out.append((key[0].as_py(), int(no[b]), float(bounds[ok[:, b], b].max())))
        return _rows(out, ["chunk", "no", "bound"], [pa.int64(), pa.int64(), pa.float64()])

    met = spread(asked).groupBy("chunk", "run").cogroup(edges.groupBy("chunk", "run")).applyInArrow(meet, "chunk long, no long, bound double")
    return Search(index, asked, settle(met, "met"), width)


def _floors(one: pa.Table, n: int) -> list[int | None]:
    out: list[int | None] = [None] * n
    for x in one.column("floors")[0].as_py() or []:
        out[x["place"]] = x["least"]
    return out


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block: int = 512, blocks_a_cell: int = 16, chunk: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id ``every`` divides, the ``k`` best of all other rows.

    Ties go to the smaller vec_id; fewer candidates give fewer rows, an empty
    table none. Rows with a null vec_id or vector, or with null or non-finite
    components, take no part; shorter vectors count as padded with zeros, empty
    ones score zero. Rows that repeat a vec_id are each candidates, but not for
    their own id, and as queries give one list. A result's score beyond 64 bits
    is an error. Other columns are not read.
    """
    found = prune(vectors, every, k, scale, block, chunk)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = found.width
    order = Window.partitionBy("chunk").orderBy(F.desc("bound"), "no")  # a row a block
    placed = found.met.withColumn("cell", F.floor((F.row_number().over(order) - 1) / blocks_a_cell).cast("long"))
    many = placed.join(found.index, "no").select("chunk", "cell", "no", "ids", "weights", "most", "least")
    cells = placed.groupBy("chunk").agg((F.max("cell") + 1).alias("cells"))
    one = found.asked.join(cells, "chunk").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).drop("cells")

    def cell(key: tuple, one: pa.Table, many: pa.Table) -> pa.Table:
        out = []
        if one.num_rows and many.num_rows:
            ids, q = _ints(one.column("ids")[0].as_py()), _ints(one.column("weights")[0].as_py(), width)
            members, index = ([_ints(x, w) for x in many.column(c).to_pylist()] for c, w in (("ids", None), ("weights", width)))
            bounds = _bounds(q, *(np.stack([_ints(x) for x in many.column(c).to_pylist()]) for c in ("most", "least")))
            for i, floor in enumerate(_floors(one, len(q))):
                by = np.argsort(-bounds[i], kind="stable").tolist()
                out += [(int(ids[i]), v, s) for s, v in _best(q[i], int(ids[i]), ((bounds[i, b], members[b], index[b]) for b in by), k, floor)]
        return _rows(out, ["query_id", "vec_id", "score"], [pa.int64()] * 3)

    rows = one.groupBy("chunk", "cell").cogroup(many.groupBy("chunk", "cell")).applyInArrow(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
