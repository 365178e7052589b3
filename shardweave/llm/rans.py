"""Token-ID output (3): static range asymmetric numeral system.

One frequency table, counted over all ids, is shared by all blocks. A block
holds whole documents; its ids are dealt to ``LANES`` interleaved coders whose
words go to one stream. Every ``ROWS`` rows a checkpoint keeps the coders'
states and the stream's place, so decoding may start there, and a checksum of
the ids that follow. States have 63 bits, words 32.

The files are Parquet (Spark writes and reads them in any store): a row is a
block's bytes in the format below, with the block's place and its documents.
Block: magic, version, scale bits, lanes, ids, words, checkpoints, then the
checkpoints (row, word, checksum, states), then the words.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardweave.llm.tokens import tokens
from shardweave.runtime import fresh_path, settle

MAGIC, VERSION = b"SWRB", 1
LANES, ROWS = 1024, 128
BLOCK = 1 << 18  # ids; a block ends with the document that reaches this
_HEAD = struct.Struct("<4sHHIQQI")
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class Corrupt(ValueError):
    """A block that isn't what was written."""


@dataclass(frozen=True)
class Table:
    """Ids in ascending order and their share of ``1 << bits``."""

    bits: int
    ids: np.ndarray
    freq: np.ndarray

    @staticmethod
    def of(ids: np.ndarray, counts: np.ndarray) -> Table:
        """Shares in proportion to ``counts``, at least one each, summing to a power of two."""
        order = np.argsort(ids)
        ids, counts = ids[order].astype(np.int64), counts[order].astype(np.float64)
        bits = max(16, math.ceil(math.log2(max(1, len(ids)))) + 4)
        total = 1 << bits
        freq = np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * total)).astype(np.int64)
        over = int(freq.sum()) - total
        while over > 0:  # the ones that were raised to one are paid for by the largest
            take = np.minimum(freq - 1, -(-freq * over // int(freq.sum())))
            take[np.cumsum(take) > over] = 0
            if not take.any():
                take[np.argmax(freq)] = min(over, int(freq.max()) - 1)
            freq -= take
            over = int(freq.sum()) - total
        if len(freq):
            freq[np.argmax(freq)] -= over
        return Table(bits, ids, freq)

    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.freq)[:-1])) if len(self.freq) else np.zeros(0, np.int64)


class Coder:
    def __init__(self, table: Table):
        self.table, self.bits = table, np.uint64(table.bits)
        self.freq, self.start = table.freq.astype(np.uint64), table.starts().astype(np.uint64)
        self.limit = np.uint64((1 << 31 >> table.bits) << 32) * self.freq
        self.slot: np.ndarray | None = None
        size = int(table.ids[-1]) + 1 if len(table.ids) else 0
        self.rank = np.full(size, -1, np.int64)
        self.rank[table.ids] = np.arange(len(table.ids))

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        rank = self.rank[ids] if n else np.zeros(0, np.int64)
        if (rank < 0).any():
            raise ValueError("an id that the table doesn't have")
        rows = -(-n // LANES)
        freq, start, limit = self.freq[rank], self.start[rank], self.limit[rank]
        x = np.full(LANES, _LOW, np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, int, np.ndarray]] = []  # row, words written by then, states
        written = 0
        for r in range(rows - 1, -1, -1):
            a, b = r * LANES, min(n, (r + 1) * LANES)
            y, f = x[: b - a], freq[a:b]
            full = y >= limit[a:b]
            if full.any():
                out.append(y[full].astype(np.uint32))
                written += len(out[-1])
                y = np.where(full, y >> _WORD, y)
            q = y // f
            x[: b - a] = (q << self.bits) + (y - q * f) + start[a:b]
            if r % ROWS == 0:
                marks.append((r, written, x.copy()))
        raw = ids.astype("<u4")
        body = [_HEAD.pack(MAGIC, VERSION, self.table.bits, LANES, n, written, len(marks))]
        for r, w, states in reversed(marks):
            crc = zlib.crc32(raw[r * LANES : (r + ROWS) * LANES].tobytes())
            body += [struct.pack("<QQI", r, written - w, crc), states.astype("<u8").tobytes()]
        body += [w.astype("<u4").tobytes() for w in reversed(out)]
        return b"".join(body)

    def checkpoints(self, block: bytes) -> tuple[int, list[tuple[int, int, int, np.ndarray]], np.ndarray]:
        """The number of ids, the checkpoints and the words of a block."""
        if len(block) < _HEAD.size:
            raise Corrupt("a block without a head")
        magic, version, bits, lanes, n, words, marks = _HEAD.unpack_from(block)
        if (magic, version, bits, lanes) != (MAGIC, VERSION, self.table.bits, LANES) or len(block) != _HEAD.size + marks * (20 + 8 * LANES) + 4 * words:
            raise Corrupt("a block of another kind or length")
        at, found = _HEAD.size, []
        for _ in range(marks):
            row, word, crc = struct.unpack_from("<QQI", block, at)
            found.append((row, word, crc, np.frombuffer(block, "<u8", LANES, at + 20)))
            at += 20 + 8 * LANES
        return n, found, np.frombuffer(block, "<u4", words, at)

    def decode_from(self, n: int, mark: tuple[int, int, int, np.ndarray], words: np.ndarray) -> np.ndarray:
        """The ids from a checkpoint to the next one."""
        if self.slot is None:
            self.slot = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.table.freq)
        row, at, crc, states = mark
        x, mask = states.astype(np.uint64), np.uint64((1 << self.table.bits) - 1)
        wide = words.astype(np.uint64)
        out = np.empty(min(n, (row + ROWS) * LANES) - row * LANES, np.int64)
        for a in range(0, len(out), LANES):
            y = x[: min(LANES, len(out) - a)]
            low = y & mask
            s = self.slot[low]
            out[a : a + len(y)] = s
            y = self.freq[s] * (y >> self.bits) + low - self.start[s]
            need = np.flatnonzero(y < _LOW)
            if len(need):
                if at + len(need) > len(wide):
                    raise Corrupt("a block that ends early")
                y[need] = (y[need] << _WORD) | wide[at : at + len(need)]
                at += len(need)
            x[: len(y)] = y
        ids = self.table.ids[out].astype("<u4")
        if zlib.crc32(ids.tobytes()) != crc:
            raise Corrupt("a checksum that doesn't fit")
        return ids

    def decode(self, block: bytes) -> np.ndarray:
        n, marks, words = self.checkpoints(block)
        parts = [self.decode_from(n, m, words) for m in marks]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_IDS = "part long, row long, doc_id long, ids binary"


def sorted_ids(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, str]:
    """(part, row, doc_id, ids) in ascending doc_id order, written once, and the ids' type: 16 bits where the vocabulary fits, else 32."""
    kind = "<u2" if max(tokens(tokenizer).tool.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part, row = tokens(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column(1).to_pylist()
            for i in range(0, len(texts), 256):
                raws = [np.frombuffer(raw + end, "<u4").astype(kind).tobytes() for raw in tool.encode(texts[i : i + 256])]
                n = len(raws)
                cols = [pa.array([part] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), b.column(0).slice(i, n), pa.array(raws, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "row", "doc_id", "ids"])
                row += n

    ordered = _docs(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return settle(ordered.mapInArrow(run, _IDS), "ids"), kind


def count_ids(ids: DataFrame, kind: str) -> Table:
    """The shared table, from all ids. What reaches the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for b in batches:
            raws = b.column(0).to_pylist()
            for i in range(0, len(raws), 1024):
                got = np.bincount(np.frombuffer(b"".join(raws[i : i + 1024]), kind), minlength=len(counts))
                got[: len(counts)] += counts
                counts = got
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return Table.of(np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64))


_BLOCKS = "part long, seq long, ids long, doc_ids binary, absent binary, lengths binary, block binary"


def write(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> None:
    """Write the ids of every text of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order.

    Every document ends in ``end_id``; a null or empty text is that id alone.
    Null doc_ids come first; rows that repeat a doc_id are written each. Other
    columns are not read. An empty table gives files without blocks. A block's
    place is its range of doc_ids (part) and its first document there (seq).
    """
    ids, kind = sorted_ids(docs, tokenizer, end_id)
    table = count_ids(ids, kind)
    entries = list(zip(table.ids.tolist(), table.freq.tolist(), strict=True))
    docs.sparkSession.createDataFrame(entries, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        names: list[int | None] = []
        raws: list[bytes] = []
        part = first = load = 0

        def block() -> pa.RecordBatch:
            nonlocal load
            flat = np.frombuffer(b"".join(raws), kind).astype(np.int64)
            known = np.array([0 if d is None else d for d in names], "<i8")
            lengths = np.array([len(r) // int(kind[2]) for r in raws], "<i8")
            row = [part, first, len(flat), known.tobytes(), np.array([d is None for d in names]).tobytes(), lengths.tobytes(), coder.encode(flat)]
            load = 0
            names.clear()
            raws.clear()
            types = [pa.int64()] * 3 + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

        for b in batches:
            for p, r, d, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if names and (load >= BLOCK or p != part or r != first + len(names)):
                    yield block()
                if not names:
                    part, first = p, r
                names.append(d)
                raws.append(raw)
                load += len(raw) // int(kind[2])
        if names:
            yield block()

    ids.mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files; blocks are decoded in parallel."""
    entries = spark.read.parquet(f"{path}/table").collect()  # bounded by the vocabulary
    ids, freq = (np.array([r[c] for r in entries], np.int64) for c in ("id", "freq"))
    order = np.argsort(ids)
    total = int(freq.sum())
    table = Table(max(0, total.bit_length() - 1), ids[order], freq[order])
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(i)[r].as_py() for i, n in enumerate(b.schema.names)}
                raw = coder.decode(row["block"]).tobytes()
                lengths = np.frombuffer(row["lengths"], "<i8")
                if 4 * lengths.sum() != len(raw):
                    raise Corrupt("documents that don't fill their block")
                ends = np.cumsum(lengths)
                parts = [raw[4 * (e - k) : 4 * e] for k, e in zip(lengths.tolist(), ends.tolist(), strict=True)]
                known, absent = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["absent"], bool)
                cols = [pa.array(known, mask=absent), pa.array([row["part"]] * len(parts)), pa.array([row["seq"]] * len(parts)), pa.array(ends - lengths), pa.array(lengths), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                cols += [pa.array(parts, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "part", "seq", "inner", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "doc_id long, part long, seq long, inner long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    found = blocks.mapInArrow(run, schema)
    sizes = blocks.select("part", "seq", "ids")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("before", F.coalesce(F.sum("ids").over(inside), F.lit(0)))
    parts = sizes.groupBy("part").agg(F.sum("ids").alias("all"))  # a row a partition
    ahead = parts.withColumn("ahead", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    places = within.join(ahead, "part").select("part", "seq", (F.col("before") + F.col("ahead")).alias("base"))
    out = found.join(places, ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def write_and_read(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, path: str | None = None) -> DataFrame:
    path = path or fresh_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
