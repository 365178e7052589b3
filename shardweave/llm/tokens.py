"""Token ids by the tokenizers library, each distinct piece of text encoded once a worker.

A text is split where the tokenizer itself always starts a new word, so the
ids of the parts put together are the ids of the whole. Texts that the quick
split does not suit are given whole to the library.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers

_KEEP = 250_000  # entries of each of two generations: bounds a worker's memory
_LONG = 200  # characters; longer parts are not kept
_GROUP = 1 << 20  # characters of texts handled at a time
_LOOSE_SPACE = re.compile(r" (?=\s|\Z)")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _bytes(ids: list[int]) -> bytes:
    a = array("I", ids)
    return a.tobytes()


def _by_space(text: str) -> list[str] | None:
    """Where white space is dropped: words. Control separators are white space to Python only."""
    return None if _SEPARATORS.search(text) else text.split()


def _before_space(text: str) -> list[str] | None:
    """Where a space belongs to the word after it: every space followed by anything but white space starts a part."""
    if _LOOSE_SPACE.search(text):
        return None
    head, *rest = text.split(" ")
    parts = [" " + p for p in rest]
    return [head, *parts] if head else parts


#: Letters up to U+00FF, digits, ASCII white space and ASCII punctuation but for the apostrophe: the normal form of such
#: a text is plain (composed already, lower case letter by letter), and these patterns split it as the tokenizers do.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = re.compile(rf"[{_LETTERS}\t-\r -&(-~]*")
_OTHERS = rf"[^\t-\r {_LETTERS}0-9]+"
_RUNS = {
    "word_bpe_49k.json": re.compile(rf"[{_LETTERS}]+|[0-9]|{_OTHERS}"),
    "byte_bpe_50k.json": re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?{_OTHERS}|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"),
}


def _visible() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


class Tokens:
    """``name``: a tokenizer file of public_tokenizers. Special tokens' strings in a text are ordinary text."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(public_tokenizers.path(name))
        self.tool.encode_special_tokens = True
        self.runs = _RUNS.get(name)
        self.model = self.tool.model
        self.lower = name == "word_bpe_49k.json"
        self.visible = _visible()
        self.split = {"word_bpe_49k.json": _by_space, "byte_bpe_50k.json": _before_space}.get(name, lambda text: None)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [_bytes(e.ids) for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, text: str) -> list[str] | None:
        """Parts whose ids put together are the text's; None: the library gets the text whole."""
        if self.runs is not None and _PLAIN.fullmatch(text):
            return self.runs.findall(text.lower() if self.lower else text)
        return self.split(text)

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of parts that ``young`` lacks; plain ones come straight from the library's model."""
        if len(self.young) + len(parts) > _KEEP:
            self.old, self.young = self.young, {}
        found, hard, old, model, run = {}, [], self.old, self.model, self.runs
        for p in parts:
            got = old.get(p)
            if got is None:
                if run is None or not _PLAIN.fullmatch(p) or not run.fullmatch(p):
                    hard.append(p)
                    continue
                shown = p.lower() if self.lower else p
                if not (shown.isascii() and shown.isalpha()):
                    shown = "".join([self.visible[b] for b in shown.encode()])
                got = _bytes([t.id for t in model.tokenize(shown)])
            found[p] = got
        if hard:
            found.update(zip(hard, self._encode(hard), strict=True))
        self.young.update((p, v) for p, v in found.items() if len(p) <= _LONG)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers; null counts as empty."""
        out: list[bytes] = []
        for i, j in _groups(texts):
            some = [t or "" for t in texts[i:j]]
            parts = [self._parts(t) for t in some]
            whole = [t for t, p in zip(some, parts, strict=True) if p is None]
            wholes = iter(self._encode(whole) if whole else [])
            look = self.young.get
            got = [None if p is None else list(map(look, p)) for p in parts]
            lacking = {w for p, g in zip(parts, got, strict=True) if g is not None and None in g for w, v in zip(p, g, strict=True) if v is None}
            new = self._learn(lacking) if lacking else {}
            for p, g in zip(parts, got, strict=True):
                if g is None:
                    out.append(next(wholes))
                else:
                    out.append(b"".join([new[w] if v is None else v for w, v in zip(p, g, strict=True)] if None in g else g))
        return out


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= _GROUP:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


@lru_cache(maxsize=4)
def tokens(name: str) -> Tokens:
    """One a worker: tasks that follow find what earlier ones have learnt."""
    return Tokens(name)
