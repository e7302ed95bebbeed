"""A run-length index of short texts: run-compressed BWT with sampled run ends.

Within a run of the BWT, the common prefix of neighbouring suffixes shrinks by
one with each step to the right in the text. So it is enough to sample suffixes
and their common prefixes at the ends of runs; reading the text from left to
right then gives, for every position, the longest match anywhere else: its
matching statistic against all the other suffixes.
Gagie, Navarro and Prezza, Fully Functional Suffix Trees and Optimal Text
Searching in BWT-Runs Bounded Space (2020).
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

END = 0xFF  # closes a text; no byte of UTF-8


class RunIndex(NamedTuple):
    """Runs of the BWT (symbol, first row) and, at both ends of each run, the suffix and its common prefix with the neighbour outside."""

    n: int
    symbol: np.ndarray
    row: np.ndarray
    head: np.ndarray
    head_lcp: np.ndarray
    tail: np.ndarray
    tail_lcp: np.ndarray


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling from eight bytes; only suffixes that still tie are sorted again."""
    n = len(text)
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[:n] = text
    key = np.ndarray(n, dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    new = np.append(True, key[sa][1:] != key[sa][:-1])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    if (padded[n - 8 if n > 8 else 0 : n] == 0).any():  # a real zero byte may tie with the padding: let lengths decide
        short = np.minimum(n - sa, 8)
        order = np.lexsort((short, key[sa]))
        sa = sa[order]
        pair = key[sa], short[order]
        new = np.append(True, (pair[0][1:] != pair[0][:-1]) | (pair[1][1:] != pair[1][:-1]))
        rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 8
    while True:
        alone = new & np.append(new[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            return sa
        at = sa[rows]
        group = rank[at]
        both = (group << 32) | (rank[np.minimum(at + h, n)] + 1)
        order = np.argsort(both)
        both, at = both[order], at[order]
        sa[rows] = at
        first = np.append(True, both[1:] != both[:-1])
        new[rows] = first
        rank[at] = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))]
        h *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, eight bytes at a time."""
    n = len(text)
    padded = np.zeros(n + 16, dtype=np.uint8)
    padded[:n] = text
    words = np.ndarray(n + 8, dtype="<u8", buffer=padded, strides=(1,))
    out = np.zeros(len(a), dtype=np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        room = n - np.maximum(x, y)
        diff = words[np.minimum(x, n)] ^ words[np.minimum(y, n)]
        low = diff & (~diff + np.uint64(1))
        same = np.where(diff == 0, 8, np.frexp(low.astype(np.float64))[1].astype(np.int64) - 1 >> 3)
        out[live] += np.minimum(same, np.maximum(room, 0))
        live = live[(same == 8) & (room > 8)]
    return out


def build(text: np.ndarray) -> RunIndex:
    n = len(text)
    sa = suffix_array(text)
    bwt = np.where(sa > 0, text[sa - 1].astype(np.int16), np.int16(256))
    row = np.flatnonzero(np.append(True, bwt[1:] != bwt[:-1]))
    lcp = np.zeros(len(row) + 1, dtype=np.int64)
    lcp[1:-1] = common_prefix(text, sa[row[1:] - 1], sa[row[1:]])
    return RunIndex(n, bwt[row], row, sa[row], lcp[:-1], sa[np.append(row[1:], n) - 1], lcp[1:])


def matching_statistics(index: RunIndex) -> np.ndarray:
    """For every position, read from left to right, the length of its longest match at another position."""
    out = np.zeros(index.n, dtype=np.int64)
    for place, length in ((index.head, index.head_lcp), (index.tail, index.tail_lcp)):
        reach = np.zeros(index.n, dtype=np.int64)
        sampled = np.full(index.n, -1, dtype=np.int64)
        sampled[place] = place
        reach[place] = length
        last = np.maximum.accumulate(sampled)
        out = np.maximum(out, reach[last] - (np.arange(index.n) - last))
    return out


def long_matches(texts: list[bytes], least: int) -> list[np.ndarray]:
    """For each of some different texts, the starts of its substrings of `least` bytes that also start elsewhere in them."""
    end = bytes([END])
    flat = np.frombuffer(end.join(texts) + end, dtype=np.uint8)
    found = matching_statistics(build(flat)) >= least
    out, at = [], 0
    for t in texts:
        out.append(np.flatnonzero(found[at : at + max(len(t) - least + 1, 0)]))
        at += len(t) + 1
    return out
