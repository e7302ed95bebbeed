"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are folded alike: letters lower-cased, every run of
other ASCII characters one space. If a stretch of a text is within e edits of an
item of m bytes, the two share at least m - q + 1 - q * e q-grams whose
diagonals (place in text less place in item) differ by at most e. So the q-grams
of each whole text are looked up among those of the items, hits are counted in
overlapping bands of diagonals of width 2e, and only bands that meet the bound
are kept. Each such region is verified: the least edit distance of the item to
any stretch of it, by dynamic programming over a band of diagonals.

The budget e is a tenth of the item's length, and q is 8 or as much less as keeps
the bound positive, so no stretch within the budget is lost, whatever the item's
length. Items of fewer than 8 folded bytes have no budget and must stand as whole
words. Items without a letter or digit match nothing, and so does a null or empty
text; repeated items and rows give repeated findings for their own ids.

An index holds at most ITEM_BYTES of items. A larger benchmark is gone through in
such blocks, one broadcast at a time. Hits are counted in steps of HITS, so that
repetitive texts and items don't fill the memory; where an item and a text repeat
one q-gram so often that its pairs outnumber the text's bytes many times, they
are counted by correlation instead of one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ready
from . import arrays as A
from .common import forget, long_ids, stored

Q = 8
BUDGET = 0.1
#: Bytes of benchmark text in one broadcast index.
ITEM_BYTES = 4 << 20
#: Hits of q-grams, and cells of alignment rows, that are looked at in one step.
HITS, CELLS = 1 << 20, 1 << 18
#: One correlation takes at most so many places of a text.
STRETCH = 1 << 20
#: Pairs of a q-gram are correlated if they are more than so many times the places.
DENSE = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:0x80] = 0x20
_FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


class Grams(NamedTuple):
    """The q-grams of the items that use one q."""

    q: int
    code: np.ndarray  # different codes, ascending
    first: np.ndarray  # first row of each code, with the count of rows at the end
    item: np.ndarray  # a row for each place of a q-gram in an item
    place: np.ndarray
    known: np.ndarray  # is any code with these top bits there?


class Items(NamedTuple):
    ids: list[np.ndarray]  # of each different folded item
    texts: list[bytes]
    edits: np.ndarray
    need: np.ndarray  # hits that a stretch within the budget has at least
    edge: np.ndarray  # 1 where the item must stand between spaces, which are part of its text here
    grams: list[Grams]


def fold(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes with a space before and after each text, their offsets, and for each folded byte its place in buf."""
    n = len(off) - 1
    twice = 2 * np.arange(n)
    inner = np.ones(len(buf) + 2 * n, dtype=bool)
    begin = off[:-1] + twice
    inner[begin] = inner[off[1:] + twice + 1] = False
    low = np.full(len(inner), 0x20, dtype=np.uint8)
    low[inner] = _FOLD[buf]
    gap = low == 0x20
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[begin] = True
    at = np.flatnonzero(keep)
    cuts = np.searchsorted(at, np.append(begin, len(low)))
    place = np.cumsum(inner) - inner
    return low[at], cuts, place[at]


def codes(buf: np.ndarray, cuts: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of q bytes (at most 8) from each place, different for different bytes, and whether one text holds them all."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    code = np.ndarray(len(buf), dtype="<u8", buffer=padded, strides=(1,)) & A.U((1 << 8 * q) - 1)
    whole = np.ones(len(buf), dtype=bool)
    for back in range(1, q):
        whole[np.maximum(cuts[1:] - back, 0)[cuts[1:] > 0]] = False
    return code * A.U(0x9E3779B97F4A7C15), whole


BITS = 20


def _top(code: np.ndarray) -> np.ndarray:
    return (code >> A.U(64 - BITS)).astype(np.int64)


def items_index(ids: list[int], texts: list[bytes], budget: float = BUDGET) -> Items:
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    buf, cuts, _ = fold(np.frombuffer(b"".join(texts), np.uint8), off)
    raw, own = buf.tobytes(), {}
    for i, a, b in zip(ids, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if raw[a:b].strip():
            own.setdefault(raw[a:b].strip(), []).append(i)
    text = list(own)
    edge = np.array([len(t) < Q for t in text], dtype=np.int64)
    text = [b" " + t + b" " if e else t for t, e in zip(text, edge.tolist(), strict=True)]
    length = np.array([len(t) for t in text], dtype=np.int64)
    edits = np.where(edge > 0, 0, (length * budget).astype(np.int64))
    width = np.minimum(Q, length // (edits + 1))
    grams = []
    for q in np.unique(width).tolist():
        mine = np.flatnonzero(width == q)
        cuts = np.concatenate([[0], np.cumsum(length[mine])])
        code, whole = codes(np.frombuffer(b"".join(text[k] for k in mine), np.uint8), cuts, q)
        at = np.flatnonzero(whole)
        owner = np.searchsorted(cuts, at, "right") - 1
        order = np.argsort(code[at], kind="stable")
        code, owner, place = code[at][order], owner[order], (at - cuts[owner])[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        known = np.zeros(1 << BITS, dtype=bool)
        known[_top(code)] = True
        grams.append(Grams(q, code[first], np.append(first, len(code)), mine[owner].astype(np.int32), place.astype(np.int32), known))
    return Items([np.array(v, dtype=np.int64) for v in own.values()], text, edits, length - width + 1 - width * edits, edge, grams)


def banded(patterns: list[np.ndarray], text: np.ndarray, low: np.ndarray, high: np.ndarray, diag: np.ndarray, width: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pattern the least edits to a stretch of text[low:high], with that stretch's start and end: rows (edits, start, end).

    Only diagonals diag .. diag + width - 1 (place in text less place in
    pattern) are filled. Where more than `most` edits are needed the row is -1.
    """
    n, wide = len(patterns), int(width.max())
    size = np.array([len(p) for p in patterns])
    letters = np.zeros((n, int(size.max())), dtype=np.uint8)
    for k, p in enumerate(patterns):
        letters[k, : len(p)] = p
    out = np.full((n, 3), -1, dtype=np.int64)
    steps = np.arange(wide, dtype=np.int64)
    live = np.arange(n)
    at = diag[:, None] + steps  # the place before the next text letter
    own = steps < width[:, None]
    far = most + 1
    value = np.where(own & (at >= low[:, None]) & (at <= high[:, None]), 0, far[:, None])
    start = np.clip(at, low[:, None], high[:, None])
    for i in range(1, letters.shape[1] + 1):
        lo, hi, cap = low[live, None], high[live, None], far[live, None]
        j = at[live] + i
        inside = own[live] & (j > lo) & (j <= hi)
        change = np.where(inside, value + (text[np.clip(j - 1, 0, len(text) - 1)] != letters[live, i - 1, None]), cap)
        drop = np.concatenate([value[:, 1:] + 1, cap], axis=1)  # a pattern letter without a partner
        from_drop = np.concatenate([start[:, 1:], start[:, -1:]], axis=1)
        first = change <= drop
        value, start = np.where(first, change, drop), np.where(first, start, from_drop)
        okay = own[live] & (j >= lo) & (j <= hi)
        value = np.where(okay, value, cap)
        # text letters without a partner: a running minimum of value less steps
        best = np.minimum.accumulate((value - steps) * (1 << 20) + steps, axis=1)
        source = best & ((1 << 20) - 1)
        value = np.where(okay, np.minimum(np.take_along_axis(value, source, 1) + steps - source, cap), cap)
        start = np.take_along_axis(start, source, 1)
        ended = size[live] == i
        if ended.any():
            rows = np.flatnonzero(ended)
            k = value[rows].argmin(axis=1)
            got = value[rows, k]
            fine = got <= most[live[rows]]
            rows, k, got = rows[fine], k[fine], got[fine]
            out[live[rows]] = np.stack([got, start[rows, k], at[live[rows], k] + i], axis=1)
        keep = ~ended & (value.min(axis=1) <= most[live])
        if not keep.all():
            live, value, start = live[keep], value[keep], start[keep]
            if not len(live):
                break
    return out


def _bands(item: np.ndarray, diag: np.ndarray, edits: np.ndarray, lift: int) -> list[np.ndarray]:
    """Keys (item, band) of both layers, one shifted by e: any e + 1 neighbouring diagonals lie in one band of width 2e."""
    span = np.maximum(2 * edits[item], 1)
    return [(item.astype(np.int64) << 40) | (diag + lift + shift * edits[item]) // span for shift in (0, 1)]


def _counted(keys: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, and how often each is there (or the sum of its counts)."""
    if count is None:
        return np.unique(keys, return_counts=True)
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.bincount(back, weights=count, minlength=len(keys)).astype(np.int64)


def _correlated(spots: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Diagonals (spot less place) and how many pairs each has, for many spots and places of one q-gram."""
    wide = int(places.max()) + 1
    flipped = np.bincount(wide - 1 - places, minlength=wide).astype(np.float64)
    for base in range(int(spots.min()), int(spots.max()) + 1, STRETCH):
        mine = spots[np.searchsorted(spots, base) : np.searchsorted(spots, base + STRETCH)] - base
        if len(mine):
            size = 1 << int(int(mine[-1]) + wide).bit_length()
            both = np.fft.irfft(np.fft.rfft(np.bincount(mine).astype(np.float64), size) * np.fft.rfft(flipped, size), size)
            n = np.rint(both).astype(np.int64)
            diag = np.flatnonzero(n)
            yield diag + base - wide + 1, n[diag]


def _full_bands(x: Items, g: Grams, text: np.ndarray, cuts: np.ndarray, lift: int) -> list[np.ndarray]:
    """For each layer the keys (item, band) with as many hits as a stretch within the budget has."""
    code, whole = codes(text, cuts, g.q)
    at = np.flatnonzero(whole & g.known[_top(code)])
    kind = np.minimum(np.searchsorted(g.code, code[at]), len(g.code) - 1)
    same = g.code[kind] == code[at]
    at, kind = at[same], kind[same]
    order = np.argsort(kind, kind="stable")  # spots of one code together, ascending
    at, kind = at[order], kind[order]
    met, begin, times = np.unique(kind, return_index=True, return_counts=True)
    # the pairs that each item would have in all; items with too few are out
    size = g.first[met + 1] - g.first[met]
    row = A.ranges(g.first[met], size)
    nth = np.repeat(np.arange(len(met)), size)
    item = g.item[row].astype(np.int64)
    total = np.bincount(item, weights=times[nth], minlength=len(x.texts))
    alive = total[item] >= np.maximum(x.need[item], 1)
    row, nth, item = row[alive], nth[alive], item[alive]
    order = np.argsort(item, kind="stable")
    row, nth, item = row[order], nth[order], item[order]
    heavy = total[item] > HITS
    found: list[list[np.ndarray]] = [[], []]

    def keep(layer: int, keys: np.ndarray, count: np.ndarray) -> None:
        found[layer].append(keys[count >= x.need[keys >> 40]])

    light = np.flatnonzero(~heavy)
    ends = np.cumsum(times[nth[light]])
    while len(light):  # whole items, up to HITS pairs
        stop = int(np.searchsorted(ends, ends[0] - times[nth[light[0]]] + HITS, "right"))
        if stop < len(light):
            stop = int(np.searchsorted(item[light], item[light[stop]]))
        step, n = light[:stop], times[nth[light[:stop]]]
        spot = at[A.ranges(begin[nth[step]], n)]
        for layer, keys in enumerate(_bands(np.repeat(item[step], n), spot - np.repeat(g.place[row[step]], n), x.edits, lift)):
            keep(layer, *_counted(keys))
        light, ends = light[stop:], ends[stop:]
    for it in np.unique(item[heavy]).tolist():
        mine = np.flatnonzero(item == it)
        sums: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def add(diag: np.ndarray, count: np.ndarray, it: int = it, sums: list = sums) -> None:
            for layer, keys in enumerate(_bands(np.full(len(diag), it), diag, x.edits, lift)):
                sums[layer].append(_counted(keys, count))
                if sum(len(k) for k, _ in sums[layer]) > HITS:
                    sums[layer][:] = [_counted(np.concatenate([k for k, _ in sums[layer]]), np.concatenate([c for _, c in sums[layer]]))]

        for k in np.unique(nth[mine]).tolist():
            spots, places = at[begin[k] : begin[k] + times[k]], g.place[row[mine[nth[mine] == k]]].astype(np.int64)
            if len(spots) * len(places) > DENSE * (int(spots[-1] - spots[0]) + int(places.max()) + HITS):
                for diag, count in _correlated(spots, places):
                    add(diag, count)
            else:
                wide = max(1, HITS // len(spots))
                for j in range(0, len(places), wide):
                    for k2 in range(0, len(spots), HITS):
                        add(*np.unique((spots[k2 : k2 + HITS] - places[j : j + wide, None]).ravel(), return_counts=True))
        for layer in (0, 1):
            if sums[layer]:
                keep(layer, *_counted(np.concatenate([k for k, _ in sums[layer]]), np.concatenate([c for _, c in sums[layer]])))
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def chunk_hits(x: Items, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows (text, item, start, end, edits) of verified stretches, in bytes of buf, the best one of each region; item is a number in x."""
    text, cuts, where = fold(buf, off)
    length = np.array([len(t) for t in x.texts], dtype=np.int64)
    lift = int(length.max(initial=0)) + 1  # a stretch may start before its text
    exact, regions = [], []
    for g in x.grams:
        for shift, keys in enumerate(_full_bands(x, g, text, cuts, lift)):
            i = keys >> 40
            e, span = x.edits[i], np.maximum(2 * x.edits[i], 1)
            base = (keys & ((1 << 40) - 1)) * span - shift * e - lift
            none = e == 0  # all q-grams of the item on one diagonal: equal
            if none.any() and not shift:
                exact.append(np.stack([np.searchsorted(cuts, base[none], "right") - 1, i[none], base[none], base[none] + length[i[none]], e[none]], axis=1))
            i, e, span, base = i[~none], e[~none], span[~none], base[~none]
            begin = np.maximum(np.searchsorted(cuts, base - e, "right") - 1, 0)
            end = np.minimum(np.searchsorted(cuts, base + span + 2 * e + length[i], "left") - 1, len(cuts) - 2)
            many = np.maximum(end - begin + 1, 0)
            regions.append(np.stack([A.ranges(begin, many), np.repeat(i, many), np.repeat(base, many)]))
    d, i, base = np.concatenate(regions, axis=1) if regions else np.zeros((3, 0), np.int64)
    e, span = x.edits[i], np.maximum(2 * x.edits[i], 1)
    low = np.maximum(base - e, cuts[d])
    high = np.minimum(base + span + 2 * e + length[i], cuts[d + 1])
    fits = high - low >= np.maximum(length[i] - e, 1)
    d, i, base, low, high = d[fits], i[fits], base[fits], low[fits], high[fits]
    raw, found, left = text.tobytes(), {}, []
    for k, (doc, it, a, b) in enumerate(zip(d.tolist(), i.tolist(), low.tolist(), high.tolist(), strict=True)):
        equal = raw.find(x.texts[it], a, b)  # the band without an edit
        if equal >= 0:
            found[doc, it, equal] = (0, equal + len(x.texts[it]))
        else:
            left.append(k)
    left = np.array(left, dtype=np.int64)
    left = left[np.argsort(length[i[left]], kind="stable")]
    while len(left):  # items of like length together, CELLS at a time
        n = max(1, int(np.searchsorted(np.arange(1, len(left) + 1) * (4 * x.edits[i[left]] + length[i[left]] // 8 + 1), CELLS, "right")))
        rows, left = left[:n], left[n:]
        e = x.edits[i[rows]]
        got = banded([np.frombuffer(x.texts[it], np.uint8) for it in i[rows].tolist()], text, low[rows], high[rows], base[rows] - e, np.maximum(2 * e, 1) + 2 * e + 1, e)
        for r, (m, begin, close) in zip(rows.tolist(), got.tolist(), strict=True):
            key = (int(d[r]), int(i[r]), begin)
            if m >= 0 and close > begin and found.get(key, (1 << 30, 0))[0] > m:
                found[key] = (m, close)
    near = np.array([(doc, it, begin, close, m) for (doc, it, begin), (m, close) in found.items()], dtype=np.int64).reshape(-1, 5)
    hits = np.concatenate([*exact, near])
    hits[:, 2] += x.edge[hits[:, 1]]
    hits[:, 3] -= x.edge[hits[:, 1]]
    hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
    last = where[hits[:, 3] - 1]
    hits[:, 2] = np.minimum(where[hits[:, 2]], off[hits[:, 0] + 1])
    hits[:, 3] = np.clip(last + 1, hits[:, 2], off[hits[:, 0] + 1])
    return hits


def item_blocks(benchmark: DataFrame, budget: float = BUDGET) -> Iterator[Items]:
    """The benchmark in blocks of at most ITEM_BYTES (a longer item comes alone), read one after the other."""
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0
    for row in benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        data = row.text.encode()
        if ids and size + len(data) > ITEM_BYTES:
            yield items_index(ids, texts, budget)
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(data)
        size += len(data)
    if ids:
        yield items_index(ids, texts, budget)


HITS_DDL = "doc_id long, item_id long, start long, end long, edits long"


def _block_hits(docs: DataFrame, index: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for c in A.chunks(batches):
            hits = chunk_hits(x, c.buf, c.off)
            lead = np.concatenate([[0], np.cumsum((c.buf & 0xC0) != 0x80)])  # spans in code points of the text
            many = np.array([len(x.ids[it]) for it in hits[:, 1].tolist()], dtype=np.int64)
            ids = np.concatenate([np.zeros(0, np.int64), *(x.ids[it] for it in hits[:, 1].tolist())])
            d, _, start, end, edits = np.repeat(hits, many, axis=0).T
            cols = [c.ids.take(pa.array(d)), pa.array(ids), pa.array(lead[start] - lead[c.off[d]]), pa.array(lead[end] - lead[c.off[d]]), pa.array(edits)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "start", "end", "edits"])

    return docs.select("doc_id", "text").transform(long_ids).transform(ready).mapInArrow(run, HITS_DDL)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, start, end and edits of every stretch of a document that is within the budget of an item, the best one where such stretches overlap."""
    context = docs.sparkSession.sparkContext
    out: DataFrame | None = None
    index: Broadcast | None = None
    hits: DataFrame | None = None
    for x in item_blocks(benchmark, budget):
        if hits is not None:  # one index at a time: what it finds is written before the next one is sent
            done = stored(hits, "benchmark-hits")
            index.destroy()
            out = done if out is None else out.union(done)
        index = context.broadcast(x)
        hits = _block_hits(docs, index)
    if hits is None:
        return docs.sparkSession.createDataFrame([], HITS_DDL)
    return hits if out is None else out.union(hits)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it: its best stretch."""
    best = F.min(F.struct("edits", "start", "end")).alias("b")
    return find_benchmark(docs, benchmark).groupBy("doc_id", "item_id").agg(best, F.count("*").alias("n_stretches")).select("doc_id", "item_id", "b.start", "b.end", "b.edits", "n_stretches")


def _without(docs: DataFrame, index: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            bad = np.zeros(len(c.off) - 1, dtype=bool)
            bad[chunk_hits(index.value, c.buf, c.off)[:, 0]] = True
            yield c.rows.filter(pc.invert(pa.array(bad)))

    return docs.transform(ready).mapInArrow(run, docs.schema)


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, all columns, in one pass per block of items."""
    index: Broadcast | None = None
    written: DataFrame | None = None
    for x in item_blocks(benchmark):
        if index is not None:
            docs, last = stored(docs, "without-benchmark"), written
            index.destroy()
            forget(last)
            written = docs
        index = docs.sparkSession.sparkContext.broadcast(x)
        docs = _without(docs, index)
    return docs
