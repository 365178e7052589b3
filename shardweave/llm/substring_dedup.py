"""Substring dedup (6): Rabin-Karp hashes of every window, counted in Spark.

Documents are dealt into blocks of bounded text by a hash of the row; a text
longer than a piece is cut into pieces that overlap by a window less a word. A
block hashes all its windows of ``width`` words to 128 bits and keeps each
distinct one once, with the first row that holds it. Then:

1. each distinct window's short fingerprint, a prefix of its hash a few bits
   longer than the number of windows needs, goes to the bucket it falls in; the
   bucket answers which fingerprints are not alone;
2. for those alone the whole hash is sent, as rows that Spark groups: a window is
   later where an earlier row holds the same 128 bits;
3. the block, hashed again, turns what is later into positions, merges them into
   maximal intervals and cuts these out.

A fingerprint takes two or three bytes a window (sorted, as differences); only
windows that may repeat cross as whole hashes. Blocks and buckets grow in number
with the text, never in size; neither reaches the driver. A block deals to
``fan`` buckets at most: beyond that it deals to runs of buckets, and relays,
each of one run and a share of the blocks, deal on to the buckets, so that
messages grow as the power 1.5 of the text and not as its square.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardweave.llm.text import whole

BLOCK_CHARS = 6_000_000
FAN = 8192
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd: the ring is that of 64-bit words
_LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of all windows of 64-bit word hashes, put together from powers of two of the width."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, piece, size = np.zeros(n, np.uint64), 0, words, 1  # piece[i]: the hash of ``size`` words from i
    while True:
        if width & size:
            out = out * np.uint64(pow(base, size, 1 << 64)) + piece[done : done + n]
            done += size
        if done == width:
            return _mix(out)
        piece = piece[:-size] * np.uint64(pow(base, size, 1 << 64)) + piece[size:]
        size *= 2


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes a word, so that a clash of words in one is none in the other."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(w) for w in words]), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


class _Block:
    """The windows of a block's rows, in an order that the rows alone fix: by doc_id, then, for pieces, by text and piece."""

    def __init__(self, docs: pa.Table, width: int, second: bool = True):
        ids, rows, pieces = (docs.column(c).to_numpy() for c in ("__key", "__row", "__piece"))
        self.texts = docs.column("__text").to_pylist()
        self.order = np.lexsort((pieces, rows, ids))
        self.key = ids[self.order], rows[self.order], pieces[self.order]
        first, other = [], []
        for i in self.order.tolist():
            a, b = _hashed(_words(self.texts[i]))
            first.append(window_hashes(a, width, _BASES[0]))
            if second:
                other.append(window_hashes(b, width, _BASES[1]))
        self.sizes = np.array([len(x) for x in first], np.int64)
        self.h = np.concatenate([*first, np.zeros(0, np.uint64)])
        self.h2 = np.concatenate([*other, np.zeros(0, np.uint64)]) if second else None
        self.doc = np.repeat(np.arange(len(self.order)), self.sizes)

    def group(self) -> None:
        """Entries: the distinct windows, in order of their hash, each with its first place."""
        self.by = by = np.lexsort((self.h2, self.h))  # stable: within equal windows, by row and position
        h, two = self.h[by], self.h2[by]
        new = np.ones(len(by), bool)
        new[1:] = (h[1:] != h[:-1]) | (two[1:] != two[:-1])
        self.entry = np.cumsum(new) - 1
        self.first = by[new]

    def fingerprints(self, shift: int) -> np.ndarray:
        """Distinct short fingerprints, ascending."""
        return np.unique(self.h >> np.uint64(shift))


def _packed(a: np.ndarray) -> bytes:
    """Ascending integers as differences of as many bytes as the largest needs."""
    steps = np.diff(a.astype("<u8"), prepend=np.zeros(1, "<u8"))
    size = max(1, (int(steps[1:].max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + steps[:1].tobytes() + steps[1:].reshape(-1, 1).view(np.uint8)[:, :size].tobytes() if len(a) else b""


def _unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.uint64)
    body = np.frombuffer(raw[9:], np.uint8).reshape(-1, raw[0])
    steps = np.zeros((len(body) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    steps[1:, : raw[0]] = body
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _parted(a: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of ascending fingerprints of ``bits`` bits by the part they fall in; parts are equal ranges."""
    part = ((a >> np.uint64(max(0, bits - 32))) * np.uint64(parts) >> np.uint64(min(bits, 32))).astype(np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(a)], strict=True):
        if e > s:
            yield int(part[s]), a[s:e]


def _not_alone(messages: list[np.ndarray]) -> list[np.ndarray]:
    """Of each message's fingerprints, those that another message has too."""
    every = np.sort(np.concatenate(messages))
    twice = every[1:][every[1:] == every[:-1]]
    out = []
    for m in messages:
        at = np.searchsorted(twice, m)
        out.append(m[(at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == m)] if len(twice) else m[:0])
    return out


def _intervals(removed: np.ndarray, width: int, n_words: int) -> np.ndarray:
    """Maximal intervals of words that windows starting at ``removed`` (ascending) cover, as rows of start and end."""
    if not len(removed):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(removed) > width) + 1
    starts, lasts = removed[np.concatenate(([0], gap))], removed[np.concatenate((gap - 1, [len(removed) - 1]))]
    return np.stack([starts, np.minimum(lasts + width, n_words)], axis=1)


def _pieces(text: str, width: int, chars: int) -> Iterator[tuple[int, str]]:
    """(first word, piece): each piece has ``chars`` characters or a little more, and the ``width`` - 1 words that follow."""
    words = text.encode("utf-8", "surrogatepass").split()
    start = 0
    while True:
        end, size = start, 0
        while end < len(words) and size < chars:
            size += len(words[end]) + 1
            end += 1
        yield start, b" ".join(words[start : end + width - 1]).decode("utf-8", "surrogatepass")
        if end >= len(words):
            return
        start = end


_ROW = "__id long, __key long, __row long, __piece long, __text string"
_SHORT = "part long, block long, prints binary"
_CUT = "doc_id long, row long, piece long, n_words long, spans array<struct<start:long,end:long>>, text string"


def _mapped(schema_names: list[str], rows: list[tuple], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.table({n: pa.array(c, t) for n, c, t in zip(schema_names, cols, types, strict=True)})


def cut_repeats(docs: DataFrame, width: int = 20, block_chars: int = BLOCK_CHARS, fan: int = FAN) -> DataFrame:
    """(doc_id, n_words, n_removed, intervals, kept) for every row of ``docs`` (doc_id, text).

    Words are runs outside [\\x20\\x09-\\x0D], unchanged. A word goes if a window of
    ``width`` words covers it whose word sequence also starts earlier: in a
    smaller doc_id, or earlier in the same text. Null, empty and short texts
    lose nothing, an empty table gives an empty result; a null doc_id comes
    last. Rows that repeat a doc_id are not earlier than each other, except that
    texts of more than ``block_chars`` bytes come in order of a hash of theirs.
    ``intervals`` are in words, ends exclusive; ``kept`` is the words that stay,
    joined by one space. Other columns are not read.
    """
    size = F.octet_length(whole(F.col("text"))).cast("long")
    total, in_long = (x or 0 for x in docs.agg(F.sum(size), F.sum(F.when(size > block_chars, size))).first())
    few = max(1, -(-(total - in_long) // block_chars))
    blocks = few + -(-2 * in_long // block_chars)  # pieces have blocks of their own
    bits = min(64, max(32, total.bit_length() + 1))  # windows are at most half as many as bytes: four fingerprints for each
    runs = blocks if blocks <= fan else max(fan // 2, isqrt(blocks))  # parts that a block deals to
    each = -(-blocks // runs)  # buckets a run

    doc_id, none = F.col("doc_id").cast("long"), F.lit(0).cast("long")
    plain = docs.select(doc_id.alias("__id"), F.coalesce(doc_id, F.lit(_LAST)).alias("__key"), none.alias("__row"), none.alias("__piece"), whole(F.col("text")).alias("__text"))
    size = F.octet_length("__text")

    def cut_long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (key, row, text) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 4)), strict=True)):
                for at, piece in _pieces(text, width, block_chars // 2):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *(pa.array([x], pa.int64()) for x in (key, row, at)), pa.array([piece], pa.string())], names=["__id", "__key", "__row", "__piece", "__text"])

    def dealt(rows: DataFrame, first: int, n: int) -> DataFrame:
        return rows.select((F.pmod(F.xxhash64("__key", "__row", "__piece", "__text"), F.lit(n)) + first).alias("block"), "*")

    kinds = [dealt(plain.where(size <= block_chars), 0, few)]
    if in_long:
        long = plain.where(size > block_chars).withColumn("__row", F.xxhash64("__text").bitwiseOR(F.lit(1)))  # never that of whole texts
        kinds.append(dealt(long.mapInArrow(cut_long, _ROW), few, blocks - few))

    def ask(table: pa.Table) -> pa.Table:
        number, out = table.column("block")[0].as_py(), {}
        for p, a in _parted(_Block(table, width, second=False).fingerprints(64 - bits), bits, runs * each):
            out.setdefault(p // each, []).append(a)
        return _mapped(["part", "block", "prints"], [(r, number, _packed(np.concatenate(a))) for r, a in out.items()], [pa.int64(), pa.int64(), pa.binary()])

    def relay(table: pa.Table) -> pa.Table:
        """Messages of several blocks to one run, as one message a bucket; ``who`` names the blocks."""
        out: dict[int, list] = {}
        for number, raw in zip(table.column("block").to_pylist(), table.column("prints").to_pylist(), strict=True):
            for p, a in _parted(_unpacked(raw), bits, runs * each):
                out.setdefault(p, []).append((number, a))
        rows = [(p, [x for x, _ in ms], [_packed(a) for _, a in ms]) for p, ms in out.items()]
        return _mapped(["part", "who", "prints"], rows, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())])

    def answer(table: pa.Table) -> pa.Table:
        if "who" in table.column_names:
            blocks_, raws = ([x for ms in table.column(c).to_pylist() for x in ms] for c in ("who", "prints"))
        else:
            blocks_, raws = table.column("block").to_pylist(), table.column("prints").to_pylist()
        found = zip(blocks_, _not_alone([_unpacked(r) for r in raws]), strict=True)
        return _mapped(["block", "prints"], [(b, zlib.compress(_packed(a), 1)) for b, a in found if len(a)], [pa.int64(), pa.binary()])

    def entries(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["h1", "h2", "ref", "id", "row", "piece"]
        if not table.num_rows or not answers.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        b = _Block(table, width)
        b.group()
        shared = np.sort(np.concatenate([_unpacked(zlib.decompress(x)) for x in answers.column("prints").to_pylist()]))
        short = b.h[b.first] >> np.uint64(64 - bits)
        at = np.searchsorted(shared, short)
        some = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == short)
        first = b.first[some]
        cols = [b.h[first].view(np.int64), b.h2[first].view(np.int64), (key[0].as_py() << 32) + some, *(k[b.doc[first]] for k in b.key)]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)})

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        names, types = ["doc_id", "row", "piece", "n_words", "spans", "text"], [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
        if not table.num_rows:
            return _mapped(names, [], types)
        b = _Block(table, width)
        b.group()
        later = np.zeros(len(b.first), bool)
        for part in answers.column("at").chunks:
            later[part.flatten().to_numpy()] = True
        gone = np.ones(len(b.h), bool)  # by window: kept only in the first row of its block, its first place there, and if no other block is earlier
        mine, first = b.doc[b.by], b.doc[b.first][b.entry]
        gone[b.by] = later[b.entry] | np.logical_or.reduce([k[mine] != k[first] for k in b.key])
        again = np.zeros(len(b.h), bool)  # the same window earlier in the same row
        same = (b.entry[1:] == b.entry[:-1]) & (mine[1:] == mine[:-1])
        again[b.by[1:][same]] = True
        gone |= again
        ends, ids, out = np.cumsum(b.sizes), table.column("__id").to_pylist(), []
        for k, i in enumerate(b.order.tolist()):
            words = _words(b.texts[i])
            spans = _intervals(np.flatnonzero(gone[ends[k] - b.sizes[k] : ends[k]]), width, len(words))
            piece, text = int(b.key[2][k]), b.texts[i]
            if not int(b.key[1][k]):  # a whole text: what is kept is made here
                text = b" ".join(_kept(words, spans.tolist())).decode("utf-8", "surrogatepass")
            out.append((ids[i], int(b.key[1][k]), piece, len(words), [{"start": s, "end": e} for s, e in spans.tolist()], text))
        return _mapped(names, out, types)

    asked = reduce(DataFrame.unionByName, (rows.groupBy("block").applyInArrow(ask, _SHORT) for rows in kinds))
    if each > 1:
        groups = max(1, isqrt(blocks))
        asked = asked.groupBy("part", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("share")).applyInArrow(relay, "part long, who array<long>, prints array<binary>")
    shared = asked.groupBy("part").applyInArrow(answer, "block long, prints binary")

    def hashes(rows: DataFrame, pieces: bool) -> DataFrame:
        """(h1, h2, ref, id, more): ref is the block and the entry in it; more tells pieces of one doc_id apart."""
        found = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(entries, "h1 long, h2 long, ref long, id long, row long, piece long")
        return found.select("h1", "h2", "ref", "id", (F.struct("row", "piece") if pieces else F.lit(None).cast("struct<row:bigint,piece:bigint>")).alias("more"))

    every = reduce(DataFrame.unionByName, (hashes(rows, i > 0) for i, rows in enumerate(kinds)))
    place = F.struct("id", "more")
    earliest = F.min(place).over(Window.partitionBy("h1", "h2"))  # a row a block at most
    later = every.withColumn("first", earliest).where(~place.eqNullSafe(F.col("first")))
    marked = later.groupBy(F.shiftright("ref", 32).alias("block")).agg(F.collect_list(F.col("ref").bitwiseAND(F.lit((1 << 32) - 1))).alias("at"))  # a block's entries at most
    done = [rows.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(cut, _CUT) for rows in kinds]
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    out = done[0].select("doc_id", "n_words", removed.alias("n_removed"), F.col("spans").alias("intervals"), F.col("text").alias("kept"))
    return out.unionByName(done[1].groupBy("doc_id", "row").applyInArrow(_join, _DONE)) if in_long else out


def _kept(words: list[bytes], spans: list[list[int]]) -> list[bytes]:
    keep, at = [], 0
    for s, e in spans:
        keep += words[at:s]
        at = e
    return keep + words[at:]


_DONE = "doc_id long, n_words long, n_removed long, intervals array<struct<start:long,end:long>>, kept string"


def _join(table: pa.Table) -> pa.Table:
    """The pieces of a long text, put together."""
    starts = table.column("piece").to_pylist()
    order = np.argsort(starts, kind="stable").tolist()
    copies = starts.count(0)  # equal rows have equal pieces
    words: list[bytes] = []
    covered: list[tuple[int, int]] = []
    for i in order[::copies]:
        at, own = starts[i], _words(table.column("text")[i].as_py())
        words += own[len(words) - at :]
        covered += [(at + s["start"], at + s["end"]) for s in table.column("spans")[i].as_py()]
    gone = np.zeros(len(words) + 1, np.int64)
    for s, e in covered:
        gone[s] += 1
        gone[e] -= 1
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(gone)[:-1] > 0).astype(np.int8), [0]))))
    spans = edge.reshape(-1, 2).tolist()
    keep = _kept(words, spans)
    row = (table.column("doc_id")[0].as_py(), len(words), len(words) - len(keep), [{"start": s, "end": e} for s, e in spans], b" ".join(keep).decode("utf-8", "surrogatepass"))
    return _mapped(["doc_id", "n_words", "n_removed", "intervals", "kept"], [row] * copies, [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
