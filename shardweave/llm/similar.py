"""SimHash near-dedup (2) at a similarity of shingle sets, for pipelines.

Two bits of a 64-bit SimHash reach only copies that are all but the same; texts
whose five-word shingle sets have a Jaccard similarity of 0.8 differ in five to
fourteen. So here the fingerprint is wider and its bytes stand alone: byte p is
the SimHash byte of sample p of the shingles, and a sample is the one shingle
that comes first in an order of its own. Two texts share each positional byte
with a chance of about their similarity. The rest is as in ``simhash``: an
inverted index over byte positions (four a key; each position is in a key of
neighbours and in one of a stride), a tally of shared positional
bytes for the pairs of a posting list, those below a minimum dropped, and the
links that are left verified on the whole shingle sets.

Posting lists yield a spanning forest of greatest tallies first. A tally is
noisy, so a tree edge may fail where another would have held: after verification
the rows of a list that are still in different components are tested against
each other in place. Lists longer than ``max_list`` are dealt into parts by a
hash that differs from key to key; the row closest to a part's consensus stands
for it, the best of these joins every part, so copies of one text meet it
wherever they are dealt. Rows that this leaves apart visit all parts of their
lists, with their shingle sets: no pairs are sent, and what a task holds is two
parts' rows. The comparisons are as many as rows outside a list's main component
times its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.operators.components import components
from shardweave.runtime import settle

BYTES, KEY = 64, 4
#: Chance that a pair just at the similarity shares fewer bytes than the minimum.
MISS = 2e-6
_rng = np.random.Generator(np.random.PCG64(20))
_ORDERS = _rng.integers(0, 1 << 63, BYTES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CHUNK = 2048


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(flat[s:e], 42) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64))


def signature(shingles: np.ndarray) -> bytes:
    """One SimHash byte for each sample; a sample has one shingle."""
    if not len(shingles):
        return bytes(BYTES)
    least = np.full(BYTES, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), _CHUNK):
        least = np.minimum(least, (shingles[i : i + _CHUNK, None] * _ORDERS).min(axis=0))
    return (least >> np.uint64(29)).astype(np.uint8).tobytes()


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, row, sid, sig) of every row; equal sets have equal sid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            sids = np.array([xxhash.xxh64_intdigest(s.tobytes(), 1) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sids), pa.array([signature(s) for s in sets], pa.binary())], names=["doc_id", "row", "sid", "sig"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("row")).mapInArrow(run, "doc_id long, row long, sid long, sig binary")


def minimum(similarity: float) -> int:
    """The most positional bytes that a pair of ``similarity`` shares but for a chance of ``MISS``; bytes are equal independently."""
    below, m = 0.0, 0
    while m < BYTES and (below := below + comb(BYTES, m) * similarity**m * (1 - similarity) ** (BYTES - m)) <= MISS:
        m += 1
    return m


def _matrix(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, BYTES)


def forest(sigs: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of greatest tallies over pairs that share ``least`` positional bytes."""
    n = len(sigs)
    best, by = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    out, left = [], np.ones(n, bool)
    for _ in range(n):  # Prim's algorithm; a row that nothing reaches starts a tree
        u = int(np.argmax(np.where(left, best, -2)))
        if best[u] >= least:
            out.append((int(by[u]), u))
        left[u] = False
        tally = (sigs == sigs[u]).sum(axis=1)
        up = left & (tally > best)
        best[up], by[up] = tally[up], u
    return out


def _postings(distinct: DataFrame, max_list: int) -> DataFrame:
    """(at, bytes, sid, sig, n, parts, part) of every list of more than one; n is the list's length."""
    step = BYTES // KEY
    keys = [F.substring("sig", KEY * i + 1, KEY) for i in range(step)]
    keys += [F.concat(*[F.substring("sig", i + step * k + 1, 1) for k in range(KEY)]) for i in range(step)]
    keys = F.array(*[F.struct(F.lit(i).alias("at"), k.alias("bytes")) for i, k in enumerate(keys)])
    posted = distinct.select("sid", "sig", F.explode(keys).alias("k")).select("sid", "sig", "k.at", "k.bytes")
    lists = posted.groupBy("at", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") * 2 / max_list)).cast("long")
    part = F.when(F.col("n") <= max_list, F.lit(0)).otherwise(F.pmod(F.xxhash64("sid", "at"), parts))
    dealt = posted.join(lists, ["at", "bytes"]).withColumn("parts", F.when(F.col("n") <= max_list, F.lit(1)).otherwise(parts).cast("long"))
    return settle(dealt.withColumn("part", part), "postings")


def _forests(met: DataFrame, least: int, max_list: int) -> DataFrame:
    """(a, b): a forest of each part, with the list's head in it."""

    def gather(rows: DataFrame) -> DataFrame:  # a part has max_list rows at most, near enough
        return rows.groupBy("at", "bytes", "part").agg(F.collect_list(F.struct("sid", "sig")).alias("rows"))

    def central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = []
            for rows in b.column("rows").to_pylist():
                m = _matrix([r["sig"] for r in rows])
                mode = np.array([np.bincount(c, minlength=256).argmax() for c in m.T], np.uint8)
                tally = (m == mode).sum(axis=1)
                i = int(tally.argmax())
                heads.append((rows[i]["sid"], rows[i]["sig"], int(tally[i])))
            sid, sig, tally = zip(*heads, strict=True) if heads else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("bytes"), pa.array(sid, pa.int64()), pa.array(sig, pa.binary()), pa.array(tally, pa.int64())], names=["at", "bytes", "sid", "sig", "tally"])

    long = met.where(F.col("n") > max_list)
    heads = gather(long).mapInArrow(central, "at int, bytes binary, sid long, sig binary, tally long")
    head = heads.groupBy("at", "bytes").agg(F.max(F.struct("tally", "sid", "sig")).alias("h"), F.first("at").alias("_")).select("at", "bytes", "h.sid", "h.sig")
    shares = long.select("at", "bytes", "part").distinct()
    visitors = head.join(shares, ["at", "bytes"]).select("at", "bytes", "part", "sid", "sig")
    rows = met.select("at", "bytes", "part", "sid", "sig").unionByName(visitors)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = set()
            for group in b.column(0).to_pylist():
                sids = [r["sid"] for r in group]
                links |= {(min(sids[i], sids[j]), max(sids[i], sids[j])) for i, j in forest(_matrix([r["sig"] for r in group]), least) if sids[i] != sids[j]}
            x, y = zip(*sorted(links), strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return gather(rows).select("rows").mapInArrow(tally, "a long, b long").distinct()


_CELL = ["at", "bytes", "part", "source"]


def _cells(met: DataFrame, label: DataFrame) -> DataFrame:
    """Rows of the lists that hold several components, dealt to cells: a part's own rows, and guests from one part.

    Rows of the component that has most of a list stay in their part; the others
    are guests in every part. So any two rows of a list that are in different
    components meet in a cell, and a cell has two parts' rows at most.
    """
    named = met.join(label, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    sizes = named.groupBy("at", "bytes", "component").agg(F.count(F.lit(1)).alias("k"))
    lists = sizes.groupBy("at", "bytes").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("kinds"))
    rest = named.join(lists.where("kinds > 1").select("at", "bytes", F.col("m.component").alias("main")), ["at", "bytes"])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    keep = [*_CELL, "sid", "sig", "component", "guest"]
    own = rest.withColumn("source", every).withColumn("guest", F.lit(False)).select(*keep)
    guests = rest.where("component <> main").withColumn("source", F.col("part")).withColumn("part", every).withColumn("guest", F.lit(True)).select(*keep)
    return own.unionByName(guests)


def _by_cell(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on each cell's rows; a task holds a cell at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for b in batches:
            cell, start = [b.column(c).to_pylist() for c in _CELL], 0
            for i, k in enumerate(zip(*cell, strict=True)):
                if k != key:
                    if i > start:
                        held.append(b.slice(start, i - start))
                    if held:
                        yield work(pa.Table.from_batches(held))
                    held, key, start = [], k, i
            if b.num_rows > start:
                held.append(b.slice(start))
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL).mapInArrow(run, schema)


def _candidates(cell: pa.Table, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each guest the rows of other components that share ``least`` bytes with it, the greatest tally first; a pair is given in the first list alone that both are in."""
    sigs, guest, kinds = _matrix(cell.column("sig").to_pylist()), cell.column("guest").to_numpy(), cell.column("component").to_numpy()
    stay, at, step = np.flatnonzero(~guest), cell.column("at")[0].as_py(), BYTES // KEY
    for g in np.flatnonzero(guest).tolist():
        same = sigs[stay] == sigs[g]
        tally = same.sum(axis=1)
        some = np.flatnonzero((tally >= least) & (kinds[stay] != kinds[g]))
        if not len(some):
            continue
        near = same[some]
        met = np.concatenate([near.reshape(-1, step, KEY).all(axis=2), near.reshape(-1, KEY, step).all(axis=1)], axis=1)
        some = some[met.argmax(axis=1) == at]
        if len(some):
            yield g, stay[some[np.argsort(-tally[some], kind="stable")]]


def _rest(docs: DataFrame, distinct: DataFrame, met: DataFrame, label: DataFrame, least: int, shingle: int, similarity: float) -> DataFrame:
    """(a, b): links between components, tested in place: a cell gets the shingle sets of the rows that have a candidate there and gives a forest of links. No pair leaves a cell untested, none is sent to be tested."""
    cells = _cells(met, label)

    def involved(cell: pa.Table) -> pa.RecordBatch:
        rows: set[int] = set()
        for g, others in _candidates(cell, least):
            rows.add(g)
            rows.update(others.tolist())
        kept = cell.take(pa.array(sorted(rows), pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([kept.column(c).combine_chunks() if kept.num_rows else pa.array([], kept.schema.field(c).type) for c in kept.column_names], names=kept.column_names)

    names = "at int, bytes binary, part long, source long, sid long, sig binary, component long, guest boolean"
    few = settle(_by_cell(cells, involved, names), "cells")
    sets = _sets(docs, distinct, few.select("sid").distinct(), shingle)

    def test(cell: pa.Table) -> pa.RecordBatch:
        sids, root = cell.column("sid").to_pylist(), {c: c for c in cell.column("component").to_pylist()}
        kinds, raws = cell.column("component").to_pylist(), cell.column("shingles")

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for g, others in _candidates(cell, least):
            x = np.frombuffer(raws[g].as_py(), np.uint64)
            for o in others.tolist():
                if (u := find(kinds[g])) != (v := find(kinds[o])) and _alike(x, np.frombuffer(raws[o].as_py(), np.uint64), similarity):
                    root[u] = v
                    links.append((min(sids[g], sids[o]), max(sids[g], sids[o])))
        x, y = zip(*links, strict=True) if links else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return _by_cell(few.join(sets, "sid"), test, "a long, b long").distinct()


def _links(docs: DataFrame, distinct: DataFrame, least: int, max_list: int, shingle: int, similarity: float) -> DataFrame:
    """Links that join what all verified pairs would: a forest by tally first, then whatever lists still hold apart."""
    met = _postings(distinct.select("sid", "sig"), max_list)
    tested = settle(_forests(met, least, max_list), "pairs")
    links = settle(_verified(docs, distinct, tested, shingle, similarity), "links")
    label = components(links, "a", "b").select(F.col("node").alias("sid"), "component")
    return links.unionByName(settle(_rest(docs, distinct, met, label, least, shingle, similarity), "links"))


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two ascending sets are as similar as asked; sets of too different sizes never are."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def _sets(docs: DataFrame, distinct: DataFrame, named: DataFrame, shingle: int) -> DataFrame:
    """(sid, shingles) of the sets that ``named`` has the sid of, written."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [shingle_set(t, shingle).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raws, pa.binary())], names=["sid", "shingles"])

    wanted = distinct.join(named, "sid").select("sid", F.col("first").alias("doc_id"), "row")
    bodies = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).join(wanted, ["doc_id", "row"]).select("sid", "text")
    return settle(bodies.mapInArrow(sets, "sid long, shingles binary").dropDuplicates(["sid"]), "shingles")


def _verified(docs: DataFrame, distinct: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets are as similar as asked."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                ok.append(_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    named = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    body = _sets(docs, distinct, named, shingle)
    left = pairs.join(body.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(body.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(compare, "a long, b long")


def row_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart; null texts are as empty ones."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_list: int = 512) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``, as ``similar_rows`` has them."""
    return similar_rows(docs, shingle, similarity, max_list).drop("row")


def similar_rows(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_list: int = 512) -> DataFrame:
    """(doc_id, row, component_id) for every row of ``docs`` (doc_id, text); row is ``row_hash`` of its text.

    Rows are linked where their sets of ``shingle``-word shingles (A-Z lower-cased)
    have a Jaccard similarity of ``similarity`` or more; component_id is the
    smallest doc_id that links reach. A text with fewer words is one shingle;
    texts without words are alike. Null doc_ids are in no component but their
    own (component_id null). Empty tables give empty results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = rows.where("doc_id IS NOT NULL")
    prints = settle(_prints(known, shingle), "prints")
    one = prints.groupBy("sid").agg(F.min(F.struct("doc_id", "row", "sig")).alias("f"))  # the row that a set is read from again, to verify
    distinct = settle(one.select("sid", F.col("f.doc_id").alias("first"), "f.row", "f.sig"), "distinct")
    least = minimum(similarity)
    links = _links(known, distinct, least, max_list, shingle, similarity)
    label = components(links, "a", "b").select(F.col("node").alias("sid"), "component")
    grouped = label.join(distinct.select("sid", "first"), "sid")
    leasts = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = grouped.join(leasts, "component").select("sid", "component_id")
    named = distinct.join(linked, "sid", "left").select("sid", F.coalesce("component_id", "first").alias("component_id"))
    found = prints.join(named, "sid").select("doc_id", "row", "component_id")
    return found.unionByName(rows.where("doc_id IS NULL").select("doc_id", row_hash(F.col("text")).alias("row"), F.lit(None).cast("long").alias("component_id")))
