"""Personal data: anchors found by an Aho-Corasick automaton, expanded by local parsers.

One pass of the automaton over each whole text finds short cues: at-signs, a
digit pair, a digit-dot-digit, a plus before a digit, address schemes and
identifier words. Each cue calls a parser that widens it to the bounds of one
candidate next to it and validates that. Kinds: email, ip, card, phone, and
beyond these `login` (user and password inside an address), `iban` (mod-97
checked), `account` (8 to 17 digits after an account cue) and `secret` (a key of
16 or more characters, with a digit, assigned to a secret's name).

Base kinds follow their pattern exactly: leftmost, not overlapping within a
kind, a failing match is dropped and the search goes on after it. A null text
counts as empty. Spans are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ready
from .common import long_ids

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban", "account", "secret")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"[\x20:#.]{0,3}(?:no|nr|number|num)?[\x20:#.]{0,3}([0-9]{8,17})(?![0-9])", re.I)

SECRET = re.compile(r"[\x20\"']{0,2}[=:][\x20\"']{0,2}((?=[A-Za-z_./+-]*[0-9])[A-Za-z0-9_./+-]{16,})")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
CUES = {"://": "login", "IBAN": "iban", "iban": "iban", "account": "account", "Account": "account", "ACCOUNT": "account", "acct": "account", "Acct": "account", "token": "secret", "secret": "secret", "password": "secret", "api_key": "secret", "apikey": "secret"}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for d in "0123456789":
        a.add_word("+" + d, ("phone", 2))
        for e in "0123456789":
            a.add_word(d + "." + e, ("ip", 3))
            for gap in ("", " ", "-"):
                a.add_word(d + gap + e, ("card", 2 + len(gap)))
    for cue, kind in CUES.items():
        a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def _back(text: str, at: int, least: int, allowed: frozenset) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def find(a: ahocorasick.Automaton, text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of one text, in order of start and kind."""
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)  # where each kind's last match ended
    for last, (kind, size) in a.iter(text):
        at, free = last + 1 - size, done[kind]
        if kind == "email":
            if at < free:
                continue
            begin = _back(text, at, free, LOCAL)
            m = EMAIL.match(text, begin) if begin < at else None
            if m:
                done[kind] = m.end()
                out.append((begin, m.end(), kind))
        elif kind == "ip":
            if at < free:
                continue
            begin = _back(text, at, free, DIGITS)
            m = IP.match(text, begin)
            if m:
                done[kind] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    out.append((begin, m.end(), kind))
        elif kind == "card":
            if at < free:
                continue
            m = CARD.match(text, at)
            done[kind] = m.end()
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((at, m.end(), kind))
        elif kind == "phone":
            if at < free:
                continue
            m = PHONE.match(text, at)
            if m:
                done[kind] = m.end()
                if 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                    out.append((at, m.end(), kind))
        elif kind == "login":
            m = LOGIN.match(text, last + 1)
            if m:
                out.append((m.start(), m.end(), kind))
        elif kind == "iban":
            m = IBAN.match(text, last + 1 + len(re.match(r"[\s:]{0,3}", text[last + 1 : last + 4]).group()))
            if m and m.start() >= free:
                code = m.group().replace(" ", "")
                if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                    done[kind] = m.end()
                    out.append((m.start(), m.end(), kind))
        else:
            m = (ACCOUNT if kind == "account" else SECRET).match(text, last + 1)
            if m and m.start(1) >= free:
                done[kind] = m.end(1)
                out.append((m.start(1), m.end(1), kind))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(out), key=lambda s: (s[0], rank[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one mask of the first kind."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


FOUND_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_pii(docs: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and all spans, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                spans = find(a, text.as_py() or "")
                base = [s for s in spans if s[2] in BASE_KINDS]
                for k, kind in enumerate(BASE_KINDS):
                    cols[k].append(sum(s[2] == kind for s in base))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(spans))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", *names])

    return docs.select("doc_id", "text").transform(long_ids).transform(ready).mapInArrow(run, FOUND_DDL)


def mask_pii(docs: DataFrame) -> DataFrame:
    """The same documents and columns with every span of `text` masked; a null text stays null."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            k = batch.schema.names.index("text")
            texts = [None if (t := x.as_py()) is None else masked(t, find(a, t)) for x in batch.column(k)]
            cols = list(batch.columns)
            cols[k] = pa.array(texts, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.transform(ready).mapInArrow(run, schema)
