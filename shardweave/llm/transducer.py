"""SentencePiece encoding and decoding (7) by a weighted finite-state transducer.

From the model file are compiled: the normaliser (a space becomes the meta
symbol, one is put before the text), the pieces (a trie whose arcs spell them
and end in their ids) and the byte fallback (characters that no piece spells
become one piece a byte, at a price above any other path's). The piece
automaton carries the merge order: an arc for a piece after another has weight
zero if the model, left alone with the two, would not merge across their
border, and infinity else; a sequence is the model's own exactly if every
neighbouring pair is so. A text is composed with this and the shortest path of
the tropical semiring read off; states are places in the text with the last
piece. Arcs are expanded when a text first needs them, and kept.

The composition falls apart where no arc crosses: at a meta symbol after any
other character (the compiler checks that no piece does). The parts between,
words for the most part, are composed once each and kept in bounded memory.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

META = "▁"
_KEEP = 250_000  # parts, and pairs, of each of two generations
_PARTS = re.compile(f"{META}+[^{META}]*|[^{META}]+")
_NEVER = float("inf")
_BYTE_PRICE = 1.0  # every other arc is free, so paths with fewer bytes win


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + size]
            at += size
        elif kind == 2:
            size = varint()
            yield key >> 3, raw[at : at + size]
            at += size
        else:
            raise ValueError("not a model file")


class Transducer:
    """Compiled from a BPE model with byte fallback and the identity normaliser; others are refused."""

    def __init__(self, model: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for field, value in _fields(model):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, 1)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35) or normaliser.get(2) or trainer.get(24):
            raise ValueError("a model of another kind")
        self.prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        self.names = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        normal, byte = 1, 6
        if any(k not in (normal, 2, 3, 5, byte) for k in self.kinds):
            raise ValueError("a model with pieces of the user's own")
        self.id = {p: i for i, (p, _, k) in enumerate(pieces) if k == normal}
        self.score = {p: s for p, s, k in pieces if k == normal}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == byte}
        if len(self.bytes) != 256 or any(META in p.lstrip(META) for p in self.id):
            raise ValueError("a model whose pieces cross words")
        self.longest = max(map(len, self.id))
        self.value = [bytes([int(p[3:5], 16)]) if k == byte else p.replace(META, " ").encode() if k == normal else b"" for p, _, k in pieces]
        self.value = [" ⁇ ".encode() if k == 2 else v for v, k in zip(self.value, self.kinds, strict=True)]
        self.trie = self._trie()
        self.rows: dict[str, dict[str, float]] = {}
        self.expanded = 0
        self.parts: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def _trie(self) -> dict:
        root: dict = {}
        for p in self.id:
            node = root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        return root

    def merged(self, symbols: list[str]) -> list[str]:
        """What the model's merges make of a few symbols: the best score first, then the leftmost."""
        symbols = list(symbols)
        while len(symbols) > 1:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.score]
            if not found:
                break
            i = min(found)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _row(self, a: str) -> dict[str, float]:
        """Weights of the arcs expanded so far in the state that ``a`` leads to."""
        row = self.rows.get(a)
        if row is None:
            if self.expanded > 2 * _KEEP:
                self.rows, self.expanded = {}, 0
            row = self.rows[a] = {}
        return row

    def _expand(self, row: dict[str, float], a: str, b: str) -> float:
        """Weight of the arc for ``b`` in the state that ``a`` leads to; ``a`` is empty at the start."""
        w = row[b] = 0.0 if self.merged([*a, *b]) == ([a, b] if a else [b]) else _NEVER
        self.expanded += 1
        return w

    def _single(self, part: str) -> list[int] | None:
        """The shortest path where every place has one live state at most, which is the common case; else None."""
        n, trie, ids = len(part), self.trie, self.id
        last: list[str | None] = [None] * (n + 1)
        before = [0] * (n + 1)
        last[0] = ""
        for i in range(n):
            a = last[i]
            if a is None:
                continue
            if part[i] not in ids:
                return None
            row, node = self._row(a), trie
            for j in range(i, n):
                node = node.get(part[j])
                if node is None:
                    break
                b = node.get("")
                if b is not None:
                    w = row.get(b)
                    if w is None:
                        w = self._expand(row, a, b)
                    if not w:
                        if last[j + 1] is not None:
                            return None
                        last[j + 1], before[j + 1] = b, i
        if last[n] is None:
            return None
        out, at = [], n
        while at:
            out.append(ids[last[at]])
            at = before[at]
        return out[::-1]

    def shortest(self, part: str) -> list[int]:
        """The ids on the shortest path of the composition with ``part``."""
        if (quick := self._single(part)) is not None:
            return quick
        n = len(part)
        states: list[dict[str, tuple[float, int, str]]] = [{} for _ in range(n + 1)]  # by last piece: cost, place and piece before
        states[0][""] = (0.0, 0, "")
        for i in range(n):
            here = states[i]
            if not here:
                continue
            node, j, arcs = self.trie, i, []
            while j < n and (node := node.get(part[j])) is not None:
                j += 1
                if "" in node:
                    arcs.append((j, node[""]))
            if part[i] not in self.id:  # the fallback; nothing merges with an unknown character
                price = _BYTE_PRICE * len(part[i].encode("utf-8", "surrogatepass"))
                cost, last = min((c, p) for p, (c, _, _) in here.items())
                old = states[i + 1].get("")
                if old is None or cost + price < old[0]:
                    states[i + 1][""] = (cost + price, i, last)
            for j, piece in arcs:
                to = states[j]
                for last, (cost, _, _) in here.items():
                    row = self._row(last)
                    w = row.get(piece)
                    total = cost + (self._expand(row, last, piece) if w is None else w)
                    if total < _NEVER and (piece not in to or total < to[piece][0]):
                        to[piece] = (total, i, last)
        if not states[n]:  # merges of equal scores can leave no such path: run them as they are
            return [t for s in self.merged(list(part)) for t in self._ids(s)]
        _, last = min((c, p) for p, (c, _, _) in states[n].items())
        at, out = n, []
        while at:
            _, before, previous = states[at][last]
            out.append((before, at, last))
            at, last = before, previous
        return [t for s, e, p in reversed(out) for t in self._ids(p or part[s:e])]

    def _ids(self, symbol: str) -> list[int]:
        found = self.id.get(symbol)
        return [found] if found is not None else [self.bytes[b] for b in symbol.encode("utf-8", "surrogatepass")]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        return (META if self.prefix and text else "") + text.replace(" ", META)

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian 32-bit integers."""
        out = []
        for part in _PARTS.findall(self.normalise(text)):
            young, old = self.parts
            got = young.get(part)
            if got is None:
                got = old.get(part)
                if got is None:
                    got = array("I", self.shortest(part)).tobytes()
                if len(part) <= 200:
                    if len(young) > _KEEP:
                        self.parts = young, old = {}, young
                    young[part] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The inverse: the text that the ids spell, without the meta symbol put first; broken UTF-8 is replaced."""
        a = array("I")
        a.frombytes(ids)
        value = self.value
        raw = b"".join([value[i] for i in a])
        return (raw[1:] if self.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducer(name: str) -> Transducer:
    """One a worker."""
    with open(public_tokenizers.path(name), "rb") as f:
        return Transducer(f.read())


_SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def encode_and_decode(docs: DataFrame, model: str = "piece_bpe_32k.model", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip) of every whole text of ``docs`` (doc_id, text).

    ``round_trip``: whether decoding gave the text back; only texts that hold the
    meta symbol itself (which decodes to a space) don't. A null text counts as
    empty and has no ids. Rows that repeat a doc_id are encoded each. An empty
    table gives an empty result; other columns are not read. ``with_ids`` adds
    the ids, as little-endian 32-bit integers, and the decoded text.
    """
    schema = _SCHEMA + (", ids binary, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = transducer(model)
        for b in batches:
            n, crcs, shas, same, ids, texts = [], [], [], [], [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                raw = tool.encode(t)
                back = tool.decode(raw)
                n.append(len(raw) // 4)
                crcs.append(zlib.crc32(raw))
                shas.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == t)
                if with_ids:
                    ids.append(raw)
                    texts.append(back)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.int64()), pa.array(shas, pa.string()), pa.array(same, pa.bool_())]
            cols += [pa.array(ids, pa.binary()), pa.array(texts, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
