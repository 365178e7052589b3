"""PII (4): patterns of fixed form, and a semi-Markov conditional random field for the rest.

The fixed patterns give the base spans, which always stay. The field adds spans
of forms they miss (spelled-out addresses, numbers with odd separators, long
addresses, credentials, identity numbers): features of the whole span score
candidate segments, and dynamic programming over segments of at most
``MAX_TOKENS`` tokens chooses boundaries and types together. Any stretch of
tokens near a mark (enough digits, a spelled-out at sign, a credential's name, a
long mixed run, colons) is a candidate: what it looks like is a feature, never a
condition. A token is a whole run without white space, so that the bound on
tokens cuts no value.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
TYPES = (*KINDS, "secret", "id")
MAX_TOKENS = 20

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The look-behind and the possessive repeats change no match; they keep long runs of digits linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = b"0123456789"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """From at sign to at sign: the leftmost match starts where the run before the sign does."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            end = found.end()
            yield "email", start, end
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    spans = list(_emails(text))
    if len(raw := text.encode("utf-8", "surrogatepass")) == len(raw.translate(None, _DIGITS)):
        return spans
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) <= 300 and int(p) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return spans


#: A token is an unbroken run of other than white space, but for brackets, quotes and stops at its edges, which are tokens of their own.
_RUN = re.compile(r"\S+")
_OPENING, _CLOSING = frozenset("([{<\"'`#*$%&|~^"), frozenset(")]}>\"'`.,;:!?=#*$%&|~^")


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    out = []
    for m in _RUN.finditer(text, start, len(text) if end is None else end):
        a, b = m.span()
        while a < b and text[a] in _OPENING:
            out.append((a, a + 1))
            a += 1
        tail = b
        while tail > a and text[tail - 1] in _CLOSING:
            tail -= 1
        if tail > a:
            out.append((a, tail))
        out += [(i, i + 1) for i in range(tail, b)]
    return out


_PLAIN = str.maketrans({c: "9" for c in "0123456789"} | {c: "a" for c in "abcdefghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_TWICE = re.compile(r"(.)\1+", re.S)
_NUMBER = re.compile(r"[0-9]+")
_NAME = re.compile(r"(?i)(?:[a-z0-9]+[_-])*?(secret|token|passw(?:or)?d|passphrase|pwd|(?:api|access|private|client)[_ -]?(?:key|secret|token)|auth(?:orization)?)(?:[_-][a-z0-9]+){0,2}[\"']?\s?[=:]\s?[\"']?(.*)", re.S)
_KEY = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk[-_]|xox[abprs]-|AIza|ya29\.|eyJ)")
_SIGN = re.compile(r"(?i)[\[({<]\s?(?:at|dot)\s?[\])}>]| (?:at|dot) ")
_HOSTS = frozenset("com org net edu gov io co uk de fr es it eu us info biz dev ai".split())
_CUES = re.compile(r"(?i)(mail|phone|tel|call|fax|mobile|card|visa|pay|ip|host|server|addr|ssn|social|security|ref|order|version|invoice|isbn|serial|part|no)\W*$")


def _classes(s: str) -> int:
    return any(c.islower() for c in s) + any(c.isupper() for c in s) + any(c.isdigit() for c in s)


def span_features(text: str, start: int, end: int) -> list[str]:
    """Features of a whole span: its shape, its digits, what it parses as, what is around it. None decides alone; the weights do."""
    s = text[start:end]
    runs = [len(r) for r in _NUMBER.findall(s)]
    d = sum(runs)
    shape = _TWICE.sub(r"\1", s.translate(_PLAIN))
    out = [f"shape={shape if len(shape) <= 16 else 'long'}", f"runs={runs if len(runs) <= 6 else 'many'}", f"digits={min(d, 20)}", f"long={min(len(s) // 8, 8)}"]
    out.append(f"edges={shape[0]}{shape[-1]}")
    out.append(f"even={all(s.count(x) == s.count(y) for x, y in ('()', '[]', '{}')) and s.count(chr(34)) % 2 == 0}")
    around = text[start - 1 : start] + text[end : end + 1] if start else text[end : end + 1]
    out.append(f"joined={any(c.isalnum() for c in around)}")
    cue = _CUES.search(text, max(0, start - 14), start)
    out.append(f"before={cue.group(1).lower() if cue else '-'}")
    if d >= 12:
        out.append(f"luhn={luhn(_digits(s))},{d}")
    if s.count(":") >= 2:
        out.append(f"six={_six(s)}")
    if signs := len(_SIGN.findall(f" {s} ")):
        last = s.rsplit(None, 1)[-1].rsplit(".", 1)[-1].rsplit("]", 1)[-1]
        sides = s.lower().split(" at ")
        out += [f"signs={min(signs, 4)}", f"host={last.lower() in _HOSTS}", f"words={min(len(s.split()), 12)}", f"plain={len(sides)},{' ' in sides[0]}"]
    if named := _NAME.match(s):
        value = named.group(2).rstrip("\"'")
        out += ["named", f"value={min(len(value) // 8, 5)},{_classes(value)},{' ' in value}"]
    elif " " not in s:
        key = _KEY.match(s)
        out.append(f"key={bool(key)},{min(len(s) // 10, 5)}")
        if len(s) >= 16:
            out.append(f"mixed={_classes(s)},{len(runs) > 1},{min(len(s) // 10, 5)}")
    out.append(f"name={bool(_NAME.search(s))},{bool(named)}")
    return out


def _six(s: str) -> bool:
    try:
        return len(s) <= 45 and bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


LABELS = ("O", *TYPES)
Segments = list[list[tuple[int, np.ndarray]]]


class SemiCRF:
    """Segments of type O have one token; others have up to ``MAX_TOKENS``. Weights are log-linear: of a feature by type, of a token left alone, of a type after another."""

    def __init__(self, names: dict[str, int] | None = None):
        self.names = names if names is not None else {}
        self.w = np.zeros((len(self.names), len(TYPES)))
        self.alone = np.zeros(1)
        self.after = np.zeros((len(LABELS) + 1, len(LABELS)))  # the last row: at the start

    def segments(self, text: str, toks: list[tuple[int, int]], marked: list[bool], shut: list[bool], learn: bool = False) -> Segments:
        """For each end, (first token, features) of every candidate that ends there.

        A candidate holds a marked token, no line break and no base span; it
        doesn't begin with what closes or end with what opens.
        """
        out: Segments = []
        for j, (_, end) in enumerate(toks):
            here = []
            if not shut[j] and text[end - 1] not in "([{<,;=:":
                seen = False
                for i in range(j, max(-1, j - MAX_TOKENS), -1):
                    if shut[i] or (i < j and "\n" in text[toks[i][1] : toks[i + 1][0]]):
                        break
                    seen = seen or marked[i]
                    start = toks[i][0]
                    if not seen or text[start] in ")]}>.,;:!?=":
                        continue
                    if learn:
                        ids = [self.names.setdefault(f, len(self.names)) for f in span_features(text, start, end)]
                    else:
                        ids = [k for f in span_features(text, start, end) if (k := self.names.get(f)) is not None]
                    here.append((i, np.array(ids, np.int64)))
            out.append(here)
        return out

    def decode(self, segs: Segments) -> list[tuple[int, int, str]]:
        """The best segmentation's typed segments, as (first token, last token, type)."""
        best, back = [np.full(len(LABELS) + 1, -np.inf)], []
        best[0][-1] = 0.0
        for j, here in enumerate(segs):
            came = best[j] + self.after[:, 0]
            u = int(came.argmax())
            score, how = np.full(len(LABELS) + 1, -np.inf), [(j, u)] * len(LABELS)
            score[0] = came[u] + self.alone[0]
            for i, ids in here:
                own = self.w[ids].sum(axis=0)
                came = best[i][:, None] + self.after[:, 1:]
                us = came.argmax(axis=0)
                total = came[us, np.arange(len(TYPES))] + own
                for t in np.flatnonzero(total > score[1:-1] + 1e-12).tolist():
                    score[1 + t], how[1 + t] = total[t], (i, int(us[t]))
            best.append(score)
            back.append(how)
        out, j = [], len(segs)
        t = int(best[j].argmax())
        while j > 0:
            i, u = back[j - 1][t]
            if t:
                out.append((i, j - 1, LABELS[t]))
            j, t = i, u
        return out[::-1]

    def likelihood(self, segs: Segments, gold: dict[tuple[int, int], str]) -> tuple[float, dict[str, np.ndarray]]:
        """Log-likelihood of a segmentation, and its gradient: observed less expected counts, by the forward and backward recursions."""
        n, lab = len(segs), len(LABELS)
        own = [[self.w[ids].sum(axis=0) for _, ids in here] for here in segs]
        fwd, into = [np.full(lab + 1, -np.inf)], []  # into[i][t]: all ways to stand before token i, then go on with t
        fwd[0][-1] = 0.0
        for j, here in enumerate(segs):
            into.append(np.logaddexp.reduce(fwd[j][:, None] + self.after, axis=0))
            now = np.full(lab + 1, -np.inf)
            now[0] = into[j][0] + self.alone[0]
            for (i, _), s in zip(here, own[j], strict=True):
                now[1:lab] = np.logaddexp(now[1:lab], into[i][1:] + s)
            fwd.append(now)
        z = float(np.logaddexp.reduce(fwd[n]))
        on = [np.full(lab, -np.inf) for _ in range(n + 1)]  # on[i][t]: all ways from a segment of type t that begins at i
        bwd = [np.full(lab + 1, -np.inf) for _ in range(n + 1)]
        bwd[n][:lab] = 0.0
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for j, here in enumerate(segs):
            for k, (i, _) in enumerate(here):
                starts[i].append((j, k))
        for i in range(n - 1, -1, -1):
            on[i][0] = self.alone[0] + bwd[i + 1][0]
            for j, k in starts[i]:
                on[i][1:] = np.logaddexp(on[i][1:], own[j][k] + bwd[j + 1][1:lab])
            bwd[i] = np.logaddexp.reduce(self.after + on[i][None, :], axis=1)
        grad = {"w": np.zeros_like(self.w), "alone": np.zeros(1), "after": np.zeros_like(self.after)}
        for i in range(n):
            grad["alone"] -= np.exp(into[i][0] + self.alone[0] + bwd[i + 1][0] - z)
            grad["after"] -= np.exp(fwd[i][:, None] + self.after + on[i][None, :] - z)
            for j, k in starts[i]:
                np.add.at(grad["w"], segs[j][k][1], -np.exp(into[i][1:] + own[j][k] + bwd[j + 1][1:lab] - z))
        total, i, u = 0.0, 0, lab
        while i < n:
            j, name = next(((e, t) for (a, e), t in gold.items() if a == i), (i, "O"))
            t = LABELS.index(name)
            total += float(self.after[u, t])
            grad["after"][u, t] += 1
            if t:
                k = next(k for k, (a, _) in enumerate(segs[j]) if a == i)
                total += float(own[j][k][t - 1])
                np.add.at(grad["w"], (segs[j][k][1], t - 1), 1.0)
            else:
                total += float(self.alone[0])
                grad["alone"] += 1
            i, u = j + 1, t
        return total - z, grad


def _examples(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Invented lines with typed spans, and look-alikes that are none."""
    rng = random.Random(seed)
    pick, between = rng.choice, rng.randint
    word = lambda: "".join(pick("aeioulnrstdmp") for _ in range(between(2, 8)))
    num = lambda k: "".join(pick("0123456789") for _ in range(k))
    hexa = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789") for _ in range(k - 2)) + pick("abc") + num(1)
    upper = lambda k: "".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k - 1)) + num(1)
    host = lambda: ".".join(word() for _ in range(between(1, 2)))

    def card(k: int, first: str) -> str:
        body = first + num(k - 1 - len(first))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def wrong(s: str) -> str:
        return s[:-1] + str((int(s[-1]) + 1) % 10)

    def spelled() -> str:
        a, z = pick(["[]", "()", "{}"])
        sign = lambda w: f" {a}{w}{z} "
        name = pick([word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}_{word()}", f"{word()}.{word()}.{word()}"])
        return name + sign("at") + pick([f"{host()}{sign('dot')}{pick(['com', 'org', 'net', 'co', 'de'])}", f"{host()}.{pick(['com', 'org', 'net'])}", f"{word()}{sign('dot')}co{sign('dot')}uk"])

    def secret() -> str:
        name = pick(["", "", "my_", "DB_", "aws-"]) + pick(["token", "api_key", "secret", "password", "passwd", "API_KEY", "access_token", "client_secret", "pwd", "TOKEN", "apikey", "private key"])
        sign = pick([" = ", "=", ": ", ":", " : "])
        value = pick([hexa(40), hexa(32), mixed(between(16, 44)), mixed(between(16, 44)), f"{mixed(20)}/{mixed(9)}+{mixed(8)}", "/".join(mixed(between(2, 20)) for _ in range(between(2, 5))), "-".join(pick("abcdef") + hexa(3) for _ in range(between(4, 8))), mixed(between(10, 16)), word() + num(2) + word() + num(2)])
        value = value.upper() if rng.random() < 0.1 else value
        quote = pick(["", '"', "'", '"'])
        return f"{name}{sign}{quote}{value}{quote}"

    fours = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, 16, 4))
    amex = lambda s, sep: sep.join((s[:4], s[4:10], s[10:]))
    six = lambda: ":".join(f"{between(0, 65535):x}" for _ in range(8))
    makers = [
        lambda: (spelled(), "email"), lambda: (spelled(), "email"),
        lambda: (f"{word()} at {word()} dot {pick(['com', 'org'])}", "email"),
        lambda: (f"({between(200, 999)}) {num(3)}-{num(4)}", "phone"), lambda: (f"{between(200, 999)}-{num(3)}-{num(4)}", "phone"),
        lambda: (f"{between(200, 999)}.{num(3)}.{num(4)}", "phone"), lambda: (f"0{num(3)} {num(3)} {num(4)}", "phone"),
        lambda: (fours(card(16, pick("45")), pick("./_")), "card"), lambda: (amex(card(15, "37"), pick([" ", "-", ""])), "card"),
        lambda: (six(), "ip"), lambda: (f"{pick(['2001:db8', 'fe80', 'fd00'])}::{':'.join(f'{between(1, 65535):x}' for _ in range(between(1, 4)))}", "ip"),
        lambda: (secret(), "secret"), lambda: (secret(), "secret"), lambda: (secret(), "secret"),
        lambda: (pick(["AKIA", "ASIA"]) + upper(16), "secret"), lambda: (pick(["ghp_", "gho_", "ghs_"]) + mixed(36), "secret"),
        lambda: (pick(["sk-", "sk_live_", "xoxb-", "AIza", "glpat-"]) + mixed(between(20, 40)), "secret"),
        lambda: (f"eyJ{mixed(between(17, 33))}.{mixed(between(20, 60))}.{mixed(between(10, 40))}", "secret"),
        lambda: (f"{between(100, 899)}-{between(10, 99)}-{num(4)}", "id"), lambda: (f"{between(100, 899)}-{between(10, 99)}-{num(4)}", "id"),
        lambda: (fours(wrong(card(16, "4")), pick("./_")), None), lambda: (amex(wrong(card(15, "37")), " "), None),
        lambda: (num(between(7, 18)), None), lambda: (f"{card(16, '4')[:15]}x", None),
        lambda: (f"{between(1900, 2030)}-{between(10, 12)}-{between(10, 28)} {between(10, 23)}:{num(2)}:{num(2)}", None), lambda: (f"{num(2)}:{num(2)}:{num(2)}", None),
        lambda: (f"version {between(1, 9)}.{between(0, 99)}.{between(0, 9999)}.{num(3)}", None), lambda: (f"{word()} at {word()} dot", None), lambda: (f"{word()} {word()} at {word()} dot {word()} {word()}", None),
        lambda: (f"{pick(['ref', 'order', 'invoice', 'part no', 'serial'])} {between(200, 999)}-{num(3)}-{num(4)}", None),
        lambda: (f"isbn 978-{num(1)}-{num(3)}-{num(5)}-{num(1)}", None), lambda: (f"{between(1, 9)},{num(3)},{num(3)}.{num(2)}", None),
        lambda: (f"{num(between(3, 6))} {word()} {num(4)} {word()}", None), lambda: (f"token of {word()}", None), lambda: (f"password: {word()}", None),
        lambda: (f"secret = {word()} {word()}", None), lambda: (f"https://{host()}.org/{word()}/{num(8)}/{word()}-{word()}", None), lambda: ("_".join(word() for _ in range(4)) + num(2), None),
        lambda: (f"{word()}{word()}{word()}{word()}", None), lambda: (f"commit {hexa(40)}", None), lambda: (f"0x{hexa(16)}", None), lambda: (f"{pick(['std', word()])}::{word()}::{word()}", None),
        lambda: (f"{between(1900, 2030)}-{between(10, 12)}-{between(10, 28)}, {num(3)} {word()}, {pick(['ref', 'no'])} {num(4)}", None), lambda: (", ".join(num(between(1, 5)) for _ in range(between(3, 5))), None),
        lambda: (f"{num(4)}-{num(4)}", None), lambda: (f"pp. {num(3)}-{num(3)} {num(4)}", None),
    ]
    out = []
    for _ in range(n):
        text, spans = " ".join(word() for _ in range(between(0, 4))), []
        for _ in range(between(1, 2)):
            s, kind = pick(makers)()
            text += pick([" ", " ", ": ", ", ", " | ", "\n"]) if text else ""
            if kind:
                spans.append((len(text), len(text) + len(s), kind))
            text += s + pick([" ", " ", ". ", ", ", ".\n", "!! ", "; "]) + " ".join(word() for _ in range(between(0, 4)))
        out.append((text, spans))
    return out


def _framed(crf: SemiCRF, text: str, spans: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], Segments, dict[tuple[int, int], str]]:
    """Tokens, candidates and the segmentation to learn; spans that are no candidates are left out."""
    toks = tokens(text)
    segs = crf.segments(text, toks, _marked(text, toks, list(_marks(text))), [False] * len(toks), learn=True)
    first, last = {s: i for i, (s, _) in enumerate(toks)}, {e: i for i, (_, e) in enumerate(toks)}
    gold = {(first[s], last[e]): k for s, e, k in spans if s in first and e in last and any(i == first[s] for i, _ in segs[last[e]])}
    return toks, segs, gold


@lru_cache(maxsize=1)
def train(n: int = 900, epochs: int = 5, seed: int = 7) -> SemiCRF:
    """Fit the field's weights to invented lines by adaptive gradient steps; the same weights every time."""
    crf = SemiCRF()
    made = [_framed(crf, text, spans)[1:] for text, spans in _examples(n, seed)]
    crf.w = np.zeros((len(crf.names), len(TYPES)))
    power = {k: np.zeros_like(getattr(crf, k)) for k in ("w", "alone", "after")}
    for _ in range(epochs):
        for segs, gold in made:
            for k, g in crf.likelihood(segs, gold)[1].items():
                power[k] += g * g
                x = getattr(crf, k)
                x += 0.4 * g / np.sqrt(power[k] + 1e-6)
        crf.w *= 0.99
    return crf


#: What every candidate holds one of: a number of seven digits or more however parted, a spelled-out sign, a credential's name, a long run of letters and digits, groups with colons.
_LOOSE = re.compile(r"(?<![0-9])[0-9](?:[ ().\-/_]{0,2}[0-9]){6,}")
_SPELLED = re.compile(r"[\[({<]\s?at\s?[\])}>]| at [^\s]+ dot ")
_NAMED = re.compile(r"(?:secret|token|passw(?:or)?d|passphrase|pwd|(?:api|access|private|client)[_ -]?key|auth(?:orization)?)(?:[_-][a-z0-9]+){0,2}[\"']?\s?[=:]")
_SOLID = re.compile(r"[A-Za-z0-9+/_=.-]{20,}")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}:(?:[0-9A-Fa-f]{0,4}:)+[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
REACH = 64  # characters around a mark that are decoded with it


def _marks(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c.lower() if c.isascii() else c for c in text)
    some = len(raw := text.encode("utf-8", "surrogatepass")) != len(raw.translate(None, _DIGITS))
    if "at" in low and ("dot" in low or "at]" in low or "at)" in low or "at}" in low or "at>" in low):
        yield from (m.span() for m in _SPELLED.finditer(low))
    if "=" in low or ":" in low:
        yield from (m.span() for m in _NAMED.finditer(low))
        yield from (m.span() for m in _COLONS.finditer(text))
    if some:
        yield from (m.span() for m in _LOOSE.finditer(text))
        yield from (m.span() for m in _SOLID.finditer(text) if _classes(m.group()) >= 2 and any(c.isdigit() for c in m.group()))


def _marked(text: str, toks: list[tuple[int, int]], marks: list[tuple[int, int]]) -> list[bool]:
    return [any(a < e and s < b for a, b in marks) for s, e in toks]


def _regions(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Stretches of text around marks, in order and apart, with the marks; none in most texts. A run of other than white space is never parted."""
    begin = end = 0
    held: list[tuple[int, int]] = []
    for s, e in sorted(_marks(text)):
        a, b = max(end, s - REACH), min(len(text), e + REACH)
        while a > end and not text[a - 1].isspace():
            a -= 1
        while end < b < len(text) and not text[b].isspace():
            b += 1
        if a > end or not held:
            if held:
                yield begin, end, held
            begin, held = a, []
        end = max(end, b)
        held.append((s, e))
    if held:
        yield begin, end, held


def find(text: str, crf: SemiCRF) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: base first, then those the field adds; each by kind and start."""
    base = base_spans(text)
    added: list[Span] = []
    taken = sorted((s, e) for _, s, e in base)
    for a, b, marks in _regions(text):
        toks = tokens(text, a, b)
        shut, k = [], 0
        for s, e in toks:
            while k < len(taken) and taken[k][1] <= s:
                k += 1
            shut.append(any(x < e for x, y in taken[k : k + 8] if y > s))
        segs = crf.segments(text, toks, _marked(text, toks, marks), shut)
        if any(segs):
            added += [(t, toks[i][0], toks[j][1]) for i, j, t in crf.decode(segs)]
    rank = {k: i for i, k in enumerate(TYPES)}
    return base, sorted({*base, *added}, key=lambda x: (rank[x[0]], x[1], x[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union is replaced by the first."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """Spans of every row's whole text: doc_id, a count for each base kind, base_sha256, spans, masked text.

    Null texts count as empty; empty texts have no spans. Offsets are code
    points, ends exclusive. Rows that repeat a doc_id are searched each for
    itself; an empty table gives an empty result; other columns are not read.
    """
    crf = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, alls, texts = [[] for _ in KINDS], [], [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                base, every = find(t, crf)
                for c, k in zip(counts, KINDS, strict=True):
                    c.append(sum(x[0] == k for x in base))
                shas.append(hashlib.sha256(listed(base).encode()).hexdigest())
                alls.append(listed(every))
                texts.append(masked(t, every) if every else t)
            cols = [*(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(alls, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "masked"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, masked string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def mask(docs: DataFrame, out: str = "masked") -> DataFrame:
    """``docs`` with the masked text in column ``out``; all other columns pass through whatever their name. Null texts become empty; an empty table stays empty."""
    crf = train()
    schema = docs.drop(out).schema
    at = schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [masked(t, spans) if (spans := find(t, crf)[1]) else t for t in (t or "" for t in b.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return docs.drop(out).mapInArrow(run, schema.add(out, "string"))
