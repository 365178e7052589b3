"""SimHash near-dedup (2): byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Fingerprints that differ in at
most k bits share at least 8-k of them. The index is keyed by unions of byte
positions: the eight positions are dealt into k+2 blocks and every pair of
blocks is a posting key, so any two linked fingerprints meet under a key at
least. Within a posting list the shared positional bytes of each pair are
tallied, pairs with fewer than 8-k are dropped, and the rest are verified on
bits. A list yields a spanning forest of its links, never all pairs.

Lists longer than ``max_list`` are keyed again by further byte positions: as a
linked pair shares 8-k bytes in all, it meets under some union of as many. Such
a list is the same but for k bytes, so it has 256^k fingerprints at most; if it
is long still, each looks up what lies within k bits of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.operators.components import components
from shardweave.runtime import settle

_CHUNK = 1 << 16  # hashes tallied at a time: bounds memory on very long texts
_PART = 256  # rows of a posting list compared at a time
_DENSE = 2048  # rows beyond which a list is looked up


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of a whole text as a signed 64-bit integer; zero where there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # on bytes: ASCII letters and white space only
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), _CHUNK):
        pairs = zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist(), strict=True)
        hashes = np.array([digest(flat[s:e], 42) for s, e in pairs], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _masks(k: int) -> list[int]:
    """For each posting key, the bits of its byte positions (signed)."""
    blocks = np.array_split(np.arange(8), k + 2)
    masks = []
    for pair in combinations(blocks, 2):
        masks.append(_signed(sum(255 << (8 * int(p)) for b in pair for p in b)))
    return masks


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _bytes(mask: int) -> set[int]:
    return {p for p in range(8) if mask >> (8 * p) & 255}


def _longer(mask: int, k: int) -> list[int]:
    """Keys of one list's pairs on further byte positions: linked fingerprints share 8 - k bytes at least, so some ``need`` of the other positions as well."""
    held = _bytes(mask)
    need = max(0, 8 - k - len(held))
    masks = [mask | sum(255 << (8 * p) for p in more) for more in combinations(sorted(set(range(8)) - held), need)]
    return masks


def forest(fps: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one posting list."""
    if len(fps) > _DENSE:
        return _looked_up(fps, k)
    x = fps.view(np.uint64)
    n = len(x)
    near = np.zeros((n, n), bool)
    for i in range(0, n, _PART):
        apart = x[i : i + _PART, None] ^ x[None, :]
        shared = (apart[..., None].view(np.uint8) == 0).sum(axis=-1)
        a, b = np.nonzero(shared >= 8 - k)
        ok = np.bitwise_count(apart[a, b]) <= k
        near[a[ok] + i, b[ok]] = True
    return _walk(fps, lambda u, left: np.flatnonzero(near[u] & left))


def _walk(fps: np.ndarray, reach) -> list[tuple[int, int]]:
    links, left = [], np.ones(len(fps), bool)
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            u = todo.pop()
            found = reach(u, left)
            left[found] = False
            links += [(int(fps[u]), int(fps[v])) for v in found]
            todo += found.tolist()
    return links


def _looked_up(fps: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The same of a long list whose fingerprints differ in two byte positions at most: each looks up all that are ``k`` bits away or fewer."""
    x = np.sort(fps.view(np.uint64))
    apart = int(np.bitwise_or.reduce(x ^ x[0]))
    bits = [1 << i for i in range(64) if apart >> i & 1]
    flips = np.array([sum(c) for n in range(1, k + 1) for c in combinations(bits, n)], np.uint64)

    def reach(u: int, left: np.ndarray) -> np.ndarray:
        want = x[u] ^ flips
        at = np.minimum(np.searchsorted(x, want), len(x) - 1)
        at = np.unique(at[x[at] == want])
        return at[left[at]]

    return _walk(x.view(np.int64), reach)


def links(distinct: DataFrame, k: int = 2, max_list: int = 1024) -> DataFrame:
    """(a, b): enough links between distinct fingerprints ``fp`` to connect all that differ in ``k`` bits or fewer."""
    if not 0 <= k <= 2:
        raise ValueError("long lists are bounded by two free byte positions: k is two at most")

    def posted(rows: DataFrame, masks: list[int]) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(m).cast("long").alias("at"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes")) for m in masks])
        return rows.select("fp", F.explode(keys).alias("p")).select("fp", "p.at", "p.bytes")

    def sized(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("at", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return settle(rows.join(lists, ["at", "bytes"]), "postings")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pair for fps in b.column(0) for pair in forest(fps.values.to_numpy(zero_copy_only=False), k)]
            a, c = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    masks = _masks(k)
    met = sized(posted(distinct, masks))
    short = met.where(F.col("n") <= max_list)
    longer = [(m, more) for m in masks for more in map(_signed, _longer(m % (1 << 64), k))]
    rest = met.where(F.col("n") > max_list)
    deep = rest.select("fp", F.explode(F.array(*[F.when(F.col("at") == m, F.lit(more)) for m, more in longer])).alias("at")).where("at IS NOT NULL")
    deep = sized(deep.select("fp", "at", F.col("fp").bitwiseAND(F.col("at")).alias("bytes")).distinct())  # 65,536 of a key at most: the other bytes are equal
    every = short.select("at", "bytes", "fp").unionByName(deep.select("at", "bytes", "fp"))
    grouped = every.groupBy("at", "bytes").agg(F.collect_list("fp").alias("fps"))
    return grouped.select("fps").mapInArrow(tally, "a long, b long").distinct()


def near_groups(docs: DataFrame, shingle: int = 3, k: int = 2, max_list: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    A-Z are lower-cased; words are runs outside [\\x20\\x09-\\x0D]; shingles count
    with repeats; a text with fewer words than a shingle is one shingle; a null,
    empty or blank text has fingerprint zero and is linked like any other. Rows
    that repeat a doc_id are fingerprinted each for itself. component_id is the
    smallest doc_id that links reach (nulls aside). Empty tables give empty
    results; other columns are not read.
    """
    prints = settle(fingerprints(docs, shingle), "fingerprints")
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    label = components(links(distinct.select("fp"), k, max_list), "a", "b").select(F.col("node").alias("fp"), "component")
    grouped = label.join(distinct, "fp")
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = grouped.join(least, "component").select("fp", "component_id")
    known = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(known, "fp")
