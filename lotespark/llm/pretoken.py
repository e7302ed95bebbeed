"""Cutting texts into the pre-tokens of two public BPE tokenizers, on code-point arrays.

Both split text into runs of letters, numbers and other marks, with English
contractions apart. The word style (white space dropped, single digits) and the
byte style (a space leads the next run, white space kept) differ as their
published patterns do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from . import arrays as A

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Unicode White_Space, and the contractions of the patterns.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


@lru_cache(maxsize=1)
def class_of() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(k))[0], OTHER) for k in range(0x110000)], dtype=np.uint8)
    out[WHITE] = SPACE
    return out


@lru_cache(maxsize=1)
def letter_code() -> np.ndarray:
    return A.mix(np.arange(1, 0x110001, dtype=A.U))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts and each text's start (one more at the end)."""
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), off


def split(cp: np.ndarray, off: np.ndarray, style: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each pre-token; style is `word` or `byte`."""
    n = len(cp)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    cls = class_of()[cp]
    cut = np.ones(n + 1, dtype=bool)
    cut[1:n] = cls[1:] != cls[:-1]
    if style == "word":
        cut[1:n] |= cls[1:] == NUMBER
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    cut |= edge
    if style == "byte":  # the last of some white space leads the next run if it is a plain space, or else stands alone
        last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~edge[1:n])
        cut[last] = True
        cut[last[cp[last] == 0x20] + 1] = False
    quote = np.flatnonzero((cp[:-1] == 0x27) & cut[:-2] & (cls[1:] == LETTER) & ~edge[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        one = np.isin(cp[quote + 1], [ord(c) for c in ONE_LETTER])
        after = np.minimum(quote + 2, n - 1)
        joined = (quote + 2 < n) & ~edge[after]
        two = np.zeros(len(quote), dtype=bool)
        for a, b in TWO_LETTERS:
            two |= joined & (cp[quote + 1] == ord(a)) & (cp[after] == ord(b))
        size = np.where(one, 2, np.where(two, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        cut[quote + 1] = False
        cut[quote + size] = True
    bounds = np.flatnonzero(cut)
    start, end = bounds[:-1], bounds[1:]
    if style == "word":
        keep = cls[start] != SPACE
        start, end = start[keep], end[keep]
    return start, end, np.searchsorted(off, start, "right") - 1


def distinct(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and index of one place of each different pre-token, and every pre-token's number among them."""
    code = A.run_hash(A.prefix(letter_code()[cp]), start, end)
    named = pa.array(code).dictionary_encode()
    number = named.indices.to_numpy()
    first = np.empty(len(named.dictionary), dtype=np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return code[first], first, number


class _Words:
    """Ids of pre-tokens by hash, in flat arrays."""

    def __init__(self) -> None:
        self.index: dict[int, int] = {}
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def find(self, codes: np.ndarray) -> np.ndarray:
        return np.fromiter(map(self.index.get, codes.tolist(), repeat(-1)), np.int64, len(codes))

    def take(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.at[where + 1] - self.at[where]
        return self.flat[A.ranges(self.at[where], size)], size

    def add(self, codes: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        where = np.arange(len(self.index), len(self.index) + len(codes))
        self.index.update(zip(codes.tolist(), where.tolist(), strict=True))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        return where


class WordCache:
    """Pre-tokens that a worker process has met, in two generations of `most` words: those in use move to the young one, the old one is dropped."""

    def __init__(self, most: int = 130_000) -> None:
        self.most = most
        self.young, self.old = _Words(), _Words()

    def ids(self, codes: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts for different codes; make(places) gives those of unknown ones."""
        if len(self.young.index) > self.most:
            self.young, self.old = _Words(), self.young
        where = self.young.find(codes)
        new = np.flatnonzero(where < 0)
        before = self.old.find(codes[new])
        known = new[before >= 0]
        where[known] = self.young.add(codes[known], *self.old.take(before[before >= 0]))
        new = new[before < 0]
        if len(new):
            where[new] = self.young.add(codes[new], *make(new))
        flat, size = self.young.take(where)
        return flat.astype(np.int64), size


@lru_cache(maxsize=4)
def word_cache(name: str) -> WordCache:
    return WordCache()


def strings(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    size = end - start
    text = cp[A.ranges(start, size)].tobytes().decode("utf-32-le")
    at = np.concatenate([[0], np.cumsum(size)]).tolist()
    return [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(0x100 + rest.index(b)) for b in range(256)]
