"""Packing (10): Karmarkar-Karp multiway differencing.

Each document's ids are cut into whole windows, which are sequences as they
are, and a rest. Rests gather until they fill a few hundred windows but for
``SLACK`` ids each; then partial partitions are merged, the two of widest
imbalance first, the fullest windows of one with the emptiest of the other,
until one partition of near-equal windows is left. Rests go in whole; only what
exceeds a window is cut off and given to windows with room, and where there is
none the partition is made again with a window more. What a task has left at its
end, less than the windows' slack and one window, goes to whole windows and then
to sequences of powers of two, which need no padding.

Nothing is shuffled: each task packs the rows it reads.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.llm.tokens import tokens

GROUP = 256  # windows packed together
SLACK = 3  # ids that a window is short of its capacity on average


def differencing(sizes: np.ndarray, m: int) -> np.ndarray:
    """The window of each item: multiway differencing of ``sizes`` into ``m`` windows."""
    n = len(sizes)
    if m == 1 or n <= 1:
        return np.zeros(n, np.int64)
    sums: list[np.ndarray | None] = [None] * n
    made: list[tuple[int, int, np.ndarray]] = []
    heap = []
    for i, s in enumerate(sizes.tolist()):
        row = np.zeros(m, np.int32)
        row[0] = s
        sums[i] = row
        heap.append((-s, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        sums[a] = sums[b] = None
        made.append((a, b, order.astype(np.int32)))
        sums.append(both)
        heapq.heappush(heap, (-int(both[0]), n + len(made) - 1))
    place: list[np.ndarray | None] = [None] * (n + len(made))
    place[-1] = np.arange(m)
    for k in range(len(made) - 1, -1, -1):  # from the last merge down: which window each slot of a partition became
        a, b, order = made[k]
        at = place[n + k]
        place[n + k] = None
        left, right = np.empty(m, np.int64), np.empty(m, np.int64)
        left[order] = at
        right[m - 1 - order] = at
        place[a], place[b] = left, right
    return np.array([place[i][0] for i in range(n)])


def windows(sizes: np.ndarray, capacity: int, spare: int = SLACK) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start, end), none above ``capacity``: whole items by differencing, then what exceeds a window cut off and given to those with room.

    There are as many windows as hold all items with ``spare`` to spare in each;
    their number rises while what is cut off finds no room.
    """
    total, m = int(sizes.sum()), 1
    m = max(1, -(-total // (capacity - spare)))
    while True:
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(m)]
        for i, w in enumerate(differencing(sizes, m).tolist()):
            out[w].append((i, 0, int(sizes[i])))
        loads = [sum(e - s for _, s, e in w) for w in out]
        over: list[tuple[int, int, int]] = []
        for w, load in zip(out, loads, strict=True):
            while load > capacity:  # from the largest item, which leaves the longest runs
                k = max(range(len(w)), key=lambda j: w[j][2] - w[j][1])
                i, s, e = w[k]
                cut = max(s, e - (load - capacity))
                over.append((i, cut, e))
                load -= e - cut
                w[k : k + 1] = [(i, s, cut)] if cut > s else []
        if sum(e - s for _, s, e in over) <= sum(max(0, capacity - x) for x in loads):
            break
        m += 1
    room = [(load - capacity, w) for w, load in enumerate(loads) if load < capacity]
    heapq.heapify(room)
    for i, s, e in sorted(over, key=lambda x: x[1] - x[2]):
        while s < e:  # into the widest room, whole where it fits
            free, w = heapq.heappop(room)
            n = min(-free, e - s)
            out[w].append((i, s, s + n))
            s += n
            if free + n < 0:
                heapq.heappush(room, (free + n, w))
    return [w for w in out if w]


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document of ``docs`` (doc_id, text): where it comes from and where it goes.

    Every document ends in ``end_id``; a null or empty text is that id alone.
    ``sequence_id`` is unique over all tasks; offsets within a sequence are
    gapless from zero. Rows that repeat a doc_id are packed each for itself. An
    empty table gives an empty result; other columns are not read. ``with_ids``
    adds the ids themselves, as little-endian 32-bit integers.
    """
    schema = _SCHEMA + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokens(tokenizer)
        base = TaskContext.get().partitionId() << 40
        number = 0
        waiting: list[tuple[int | None, int, int, bytes]] = []  # doc_id, start, ids of the document, ids of the piece
        load = 0
        rows: list[tuple] = []

        def put(piece: tuple[int | None, int, int, bytes], sequence: int, offset: int) -> int:
            doc, start, total, ids = piece
            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, base + sequence, offset, ids))
            return offset + len(ids) // 4

        def split(keep: int) -> tuple[list, list]:
            """The pieces waiting, in two: the first ``keep`` ids and the others."""
            front, back, at = [], [], 0
            for doc, start, total, ids in waiting:
                n = min(max(0, keep - at), len(ids) // 4)
                front += [(doc, start, total, ids[: 4 * n])] if n else []
                back += [(doc, start + n, total, ids[4 * n :])] if 4 * n < len(ids) else []
                at += len(ids) // 4
            return front, back

        def place() -> None:
            nonlocal number, load, waiting
            m = load // capacity
            front, waiting = split(m * (capacity - SLACK))
            load -= m * (capacity - SLACK)
            if not front:
                return
            for window in windows(np.array([len(w[3]) // 4 for w in front], np.int64), capacity):
                at = 0
                for i, s, e in window:
                    doc, start, total, ids = front[i]
                    at = put((doc, start + s, total, ids[4 * s : 4 * e]), number, at)
                number += 1

        def finish() -> None:
            nonlocal number, load, waiting
            place()
            while waiting:
                size = capacity if load >= capacity else 1 << (load.bit_length() - 1)
                front, waiting = split(size)
                load -= size
                at = 0
                for piece in front:
                    at = put(piece, number, at)
                number += 1

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            names = [*(c.split()[0] for c in _SCHEMA.split(", ")), *(["ids"] if with_ids else [])]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, cols, strict=False)], names=names)
            rows.clear()
            return out

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(ids), 64):
                for doc, raw in zip(ids[i : i + 64], tool.encode(texts[i : i + 64]), strict=True):
                    raw += end
                    total, full = len(raw) // 4, len(raw) // 4 // capacity * capacity
                    for s in range(0, full, capacity):
                        put((doc, s, total, raw[4 * s : 4 * (s + capacity)]), number, 0)
                        number += 1
                    if full < total:
                        waiting.append((doc, full, total, raw[4 * full :]))
                        load += total - full
                    if load >= GROUP * capacity:
                        place()
                if len(rows) >= 10000:
                    yield batch()
        finish()
        yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
