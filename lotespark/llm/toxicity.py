"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A token is a run of letters and digits, ASCII case folded. Its input joins a
hashed word vector with the mean vector of its byte pairs (the character
input). Windows of 24 tokens, each starting 16 after the last so that
neighbours overlap, are read in both directions; attention pools the states
and a logistic unit scores the window. A document's score is that of its worst
window, over its whole text. Training is numpy: each document is a bag of
windows of which the worst carries the label. One coordinate of the word
vectors starts from the word's smoothed log odds in the training rows.

Null and empty texts, and texts without tokens, get the score of an empty
window. With no labelled rows every score is 0. Few labels are gone through more
often, at least STEPS steps in all, and the score's level starts from the share of
toxic rows; with fewer than LEAST_LABELS of either kind a warning says that
scores mean little. Of rows that repeat a doc_id one text is learnt from.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ready
from . import arrays as A
from .common import long_ids

TOKENS = 24
STRIDE = 16
HIDDEN = 8
WORD_SLOTS = 1 << 16
WORD_DIM = 4
CHAR_DIM = 8
THRESHOLD = 0.3
#: Labelled documents that training takes at most, and their longest text in bytes (longer ones aren't learnt from).
TRAIN_DOCS = 4000
TRAIN_BYTES = 20_000
#: Labelled documents of each kind below which learning warns, and the least number of training steps.
LEAST_LABELS, STEPS = 50, 400

BREAK = np.ones(256, dtype=bool)
BREAK[0x30:0x3A] = BREAK[0x41:0x5B] = BREAK[0x61:0x7B] = BREAK[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _char_class() -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[0x30:0x3A] = 27
    for k in range(26):
        out[0x61 + k] = out[0x41 + k] = 1 + k
    out[0x80:] = 28 + (np.arange(0x80, 0x100) & 31)
    return out


CHAR_CLASS = _char_class()


class Model(NamedTuple):
    p: dict[str, np.ndarray]


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of a chunk (start and end of one place of each), each token's number, and its document."""
    low, found, at = LOWER[buf], [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, A.U),)], 0
    while at < len(off) - 1:  # some texts at a time, so that many need no more memory for their hashes than a few
        end = max(at + 1, int(np.searchsorted(off, off[at] + A.CHUNK_BYTES, "right")) - 1)
        part = low[off[at] : off[end]]
        s, e, d = A.word_bounds(part, off[at : end + 1] - off[at], BREAK)
        found.append((s + off[at], e + off[at], d + at, A.bytes_hash(part, s, e)))
        at = end
    starts, ends, doc, code = (np.concatenate(f) for f in zip(*found, strict=True))
    distinct, first, number = np.unique(code, return_index=True, return_inverse=True)
    return np.stack([starts[first], ends[first], (distinct % A.U(WORD_SLOTS)).astype(np.int64)]), number, doc, low


def char_pairs(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte-pair classes of each token, the token's end paired with class 0, and the token each belongs to."""
    at = A.ranges(starts, ends - starts)
    token = np.repeat(np.arange(len(starts)), ends - starts)
    cls = CHAR_CLASS[low[at]]
    after = np.append(cls[1:], 0)
    after[np.cumsum(ends - starts) - 1] = 0
    return cls * 60 + after, token


def char_means(table: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    if not len(sizes):
        return np.zeros((0, table.shape[1]), np.float32)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.add.reduceat(table[pairs], first, axis=0) / sizes[:, None].astype(np.float32)


def cut_windows(doc: np.ndarray, n: int, pad: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers [windows, TOKENS] of all overlapping windows, padded, and each window's document."""
    first = A.word_offsets(doc, n)
    size = first[1:] - first[:-1]
    count = np.maximum(1, -(-(size - TOKENS) // STRIDE) + 1)
    owner = np.repeat(np.arange(n), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = first[owner] + nth * STRIDE
    place = at[:, None] + np.arange(TOKENS)
    inside = place < first[owner + 1][:, None]
    padded = np.append(number, pad)
    return np.where(inside, padded[np.minimum(place, len(number))], pad), owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def inputs(p: dict[str, np.ndarray], slots: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Input sums of the gates, both directions, for each token; a last row keeps the state for padding."""
    x = np.concatenate([p["word"][slots], chars], axis=1) @ p["win"] + p["bin"]
    pad = np.zeros((1, x.shape[1]), np.float32)
    pad[0, :HIDDEN] = pad[0, 3 * HIDDEN : 4 * HIDDEN] = 30.0  # update gate shut
    return np.concatenate([x, pad])


def read(p: dict[str, np.ndarray], x: np.ndarray, idx: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States [windows, TOKENS, 2 * HIDDEN]; with keep, also what the backward pass needs."""
    h2, kept = HIDDEN, []
    states = np.empty((len(idx), TOKENS, 2 * h2), np.float32)
    for d in (0, 1):
        u, un = p[f"u{d}"], p[f"un{d}"]
        xd = np.ascontiguousarray(x[:, d * 3 * h2 : (d + 1) * 3 * h2])
        h = np.zeros((len(idx), h2), np.float32)
        for t in range(TOKENS) if d == 0 else range(TOKENS - 1, -1, -1):
            xt = xd.take(idx[:, t], axis=0)
            zr = sigmoid(xt[:, : 2 * h2] + h @ u)
            z, r = zr[:, :h2], zr[:, h2:]
            hn = h @ un
            n = np.tanh(xt[:, 2 * h2 :] + r * hn)
            if keep:
                kept.append((d, t, h, z, r, hn, n))
            h = n + z * (h - n)
            states[:, t, d * h2 : (d + 1) * h2] = h
    return states, kept


def attend(p: dict[str, np.ndarray], states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, tuple]:
    a = np.tanh(states @ p["wa"])
    s = np.where(real, a @ p["va"], np.float32(-30))
    w = np.exp(s - s.max(axis=1, keepdims=True))
    w /= w.sum(axis=1, keepdims=True)
    pooled = np.matmul(w[:, None, :], states)[:, 0]
    return pooled @ p["wo"] + p["bo"], (a, w, pooled)


def window_logits(p: dict[str, np.ndarray], x: np.ndarray, idx: np.ndarray, step: int = 3072) -> np.ndarray:
    out, pad = np.empty(len(idx), np.float32), len(x) - 1
    for k in range(0, len(idx), step):
        part = idx[k : k + step]
        out[k : k + step] = attend(p, read(p, x, part)[0], part != pad)[0]
    return out


def summed(at: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """The sums of the values' rows that share a number in `at`."""
    out = np.empty((rows, values.shape[1]), np.float32)
    for k in range(values.shape[1]):
        out[:, k] = np.bincount(at, weights=values[:, k], minlength=rows)
    return out


def gradients(p: dict[str, np.ndarray], slots: np.ndarray, chars: np.ndarray, idx: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradients of the mean log loss of windows idx, that of the characters' means, and the loss."""
    h2, x, pad = HIDDEN, inputs(p, slots, chars), len(slots)
    real = idx != pad
    states, kept = read(p, x, idx, keep=True)
    logit, (a, w, pooled) = attend(p, states, real)
    prob = sigmoid(logit)
    loss = float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))
    g = {k: np.zeros_like(v) for k, v in p.items()}
    dl = ((prob - y) / len(y)).astype(np.float32)
    g["wo"], g["bo"] = pooled.T @ dl, dl.sum()
    dpool = dl[:, None] * p["wo"]
    dstates = w[:, :, None] * dpool[:, None, :]
    dw = np.matmul(states, dpool[:, :, None])[:, :, 0]
    ds = w * (dw - (w * dw).sum(axis=1, keepdims=True)) * real
    g["va"] = np.einsum("bt,btk->k", ds, a)
    da = ds[:, :, None] * p["va"] * (1 - a * a)
    g["wa"] = np.einsum("bth,btk->hk", states, da)
    dstates += da @ p["wa"].T
    dgates = np.empty((*idx.shape, x.shape[1]), np.float32)
    carry = [np.zeros((len(idx), h2), np.float32) for _ in (0, 1)]
    for d, t, h, z, r, hn, n in reversed(kept):
        dh = carry[d] + dstates[:, t, d * h2 : (d + 1) * h2]
        dz, dn = dh * (h - n) * z * (1 - z), dh * (1 - z) * (1 - n * n)
        dr = dn * hn * r * (1 - r)
        dzr = np.concatenate([dz, dr], axis=1)
        g[f"u{d}"] += h.T @ dzr
        g[f"un{d}"] += h.T @ (dn * r)
        carry[d] = dh * z + dzr @ p[f"u{d}"].T + (dn * r) @ p[f"un{d}"].T
        dgates[:, t, d * 3 * h2 : (d + 1) * 3 * h2] = np.concatenate([dzr, dn], axis=1)
    dx = summed(idx.ravel(), dgates.reshape(-1, x.shape[1]), len(x))[:-1]
    both = np.concatenate([p["word"][slots], chars], axis=1)
    g["win"], g["bin"] = both.T @ dx, dx.sum(axis=0)
    dboth = dx @ p["win"].T
    g["word"] = summed(slots, dboth[:, :WORD_DIM], len(p["word"]))
    return g, dboth[:, WORD_DIM:], loss


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    f = lambda *s, scale=0.3: rng.normal(0, scale, s).astype(np.float32)
    p = {"word": f(WORD_SLOTS, WORD_DIM, scale=0.05), "char": f(60 * 60, CHAR_DIM, scale=0.3), "win": f(WORD_DIM + CHAR_DIM, 6 * HIDDEN), "bin": np.zeros(6 * HIDDEN, np.float32)}
    for d in (0, 1):
        p |= {f"u{d}": f(HIDDEN, 2 * HIDDEN), f"un{d}": f(HIDDEN, HIDDEN)}
    return p | {"wa": f(2 * HIDDEN, HIDDEN), "va": f(HIDDEN), "wo": f(2 * HIDDEN), "bo": np.float32(-2.0)}


def fit(texts: list[bytes], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    p = start(rng)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    spans, number, doc, low = tokens(np.frombuffer(b"".join(texts), np.uint8), off)
    # log odds of a word: in how many training documents of each kind it occurs
    seen = np.unique(number + doc.astype(np.int64) * len(spans[0])) if len(number) else np.zeros(0, np.int64)
    word_of, doc_of = seen % max(1, len(spans[0])), seen // max(1, len(spans[0]))
    bad = np.bincount(word_of, weights=y[doc_of] if len(doc_of) else None, minlength=len(spans[0]))
    every = np.bincount(word_of, minlength=len(spans[0]))
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((every - bad + 0.5) / (len(y) - y.sum() + 1))
    strong = every >= 5
    p["word"][spans[2][strong], 0] = np.clip(odds[strong], -4, 4) / 2
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    idx, owner = cut_windows(doc, len(texts), len(spans[0]), number)
    first = A.word_offsets(owner, len(texts))
    turns = -(-len(texts) // batch)
    epochs = max(epochs, -(-STEPS // turns))
    share = np.clip(y.mean(), 0.01, 0.99)
    p["bo"] = np.float32(np.log(share / (1 - share)))
    step, total = 0, epochs * turns
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            docs = order[k : k + batch]
            rows = A.ranges(first[docs], first[docs + 1] - first[docs])
            used, sub = np.unique(idx[rows], return_inverse=True)
            sub = sub.reshape(len(rows), TOKENS)
            pad = len(spans[0])
            real_used = used[used != pad]
            pairs, token = char_pairs(low, spans[0][real_used], spans[1][real_used])
            sizes = spans[1][real_used] - spans[0][real_used]
            chars = char_means(p["char"], pairs, sizes)
            sub = np.where(used[sub] == pad, len(real_used), sub)
            logit = window_logits(p, inputs(p, spans[2][real_used], chars), sub)
            bag = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            by_bag = np.lexsort((logit, bag))
            worst = by_bag[np.append(bag[by_bag][1:] != bag[by_bag][:-1], True)]
            g, dchar, _ = gradients(p, spans[2][real_used], chars, sub[worst], y[docs].astype(np.float32))
            g["char"] = summed(pairs, (dchar / sizes[:, None])[token], len(p["char"]))
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            for name in p:
                a, b, gr = m1[name], m2[name], g[name]
                m1[name] = a = a + 0.1 * (gr - a)
                m2[name] = b = b + 0.01 * (gr * gr - b)
                p[name] = p[name] - np.float32(lr) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + np.float32(1e-7))
    return Model(p)


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = TRAIN_DOCS) -> Model | None:
    """A model from at most `most` labelled documents, those least in a hash of doc_id."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
    if usable is not None:
        marked = marked.where(usable)
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(marked), "doc_id")
    got = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).toPandas().sort_values("doc_id", kind="stable")
    if got.empty:
        return None
    toxic = (got["toxic"] == 1).to_numpy().astype(np.float64)
    if min(toxic.sum(), len(toxic) - toxic.sum()) < LEAST_LABELS:
        warnings.warn(f"toxicity learns from {int(toxic.sum())} toxic and {int(len(toxic) - toxic.sum())} other texts; scores from fewer than {LEAST_LABELS} of either mean little", stacklevel=2)
    return fit([t.encode() for t in got["text"]], toxic)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            n = len(c.off) - 1
            worst = np.full(n, -np.inf)
            if model:
                p = model.p
                spans, number, doc, low = tokens(c.buf, c.off)
                pairs, _ = char_pairs(low, spans[0], spans[1])
                x = inputs(p, spans[2], char_means(p["char"], pairs, spans[1] - spans[0]))
                idx, owner = cut_windows(doc, n, len(spans[0]), number)
                np.maximum.at(worst, owner, window_logits(p, x, idx))
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(sigmoid(worst))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").transform(long_ids).transform(ready).mapInArrow(run, "doc_id long, score double")
