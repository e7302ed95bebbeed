"""Language identification by a byte convolutional network.

Bytes fold into 64 classes (letters without case, digits, white space, other
ASCII, and the low bits of bytes beyond ASCII). Filters of widths 2, 3 and 4 run
over windows of 256 bytes, their largest responses are pooled, and a softmax
gives the languages. Training is numpy on labelled text; a document's
probabilities are the mean over all windows that cover its whole text, weighted
by their bytes.

A null text, or one without letters, is `und` with score 0. With no labelled
rows every document is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from ..runtime import ready
from . import arrays as A

WINDOW = 256
CLASSES = 64
PAD = CLASSES - 1
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled documents that training takes at most (those least in a hash of doc_id), and windows of each.
TRAIN_DOCS = 3000
TRAIN_WINDOWS = 4
UNKNOWN = "und"


def _classes() -> np.ndarray:
    out = np.full(256, 28, dtype=np.uint8)  # other ASCII
    for k in range(26):
        out[0x41 + k] = out[0x61 + k] = k
    out[A.SPACE] = 26
    out[0x30:0x3A] = 27
    out[0x80:] = 29 + (np.arange(0x80, 0x100) & 31)
    return out


CLASS_OF = _classes()
LETTER = np.zeros(256, dtype=bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True


class Model(NamedTuple):
    langs: tuple[str, ...]
    filters: tuple[np.ndarray, ...]  # per width [width, CLASSES, FILTERS]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def cut_windows(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes of all windows [n, WINDOW] of a chunk, each window's document and its true length."""
    size = off[1:] - off[:-1]
    count = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.full(int(first[-1]) * WINDOW, PAD, dtype=np.uint8)
    out[A.ranges(first[:-1] * WINDOW, size)] = CLASS_OF[buf]
    doc = np.repeat(np.arange(len(size)), count)
    length = np.minimum(WINDOW, size[doc] - (np.arange(len(doc)) - first[doc]) * WINDOW)
    return out.reshape(-1, WINDOW), doc, length


def _tables(filters: tuple[np.ndarray, ...]) -> list[list[tuple[int, bool, np.ndarray]]]:
    """Each filter bank as sums of table rows: (offset, by pair of bytes, table)."""
    pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, -1))
    out = []
    for w in filters:
        parts = [(k, True, pair(w[k], w[k + 1])) for k in range(0, len(w) - 1, 2)]
        out.append(parts + ([(len(w) - 1, False, np.ascontiguousarray(w[-1]))] if len(w) % 2 else []))
    return out


def _responses(x: np.ndarray, bank: list[tuple[int, bool, np.ndarray]], width: int) -> np.ndarray:
    """Filter responses [windows, positions, FILTERS]."""
    n = WINDOW - width + 1
    total = None
    for k, by_pair, rows in bank:
        key = x[:, k : k + n].astype(np.int32)
        if by_pair:
            key = key * CLASSES + x[:, k + 1 : k + 1 + n]
        part = rows.take(key.ravel(), axis=0)
        total = part if total is None else np.add(total, part, out=total)
    return total.reshape(len(x), n, -1)


def pooled(m: Model, x: np.ndarray, banks: list) -> np.ndarray:
    return np.concatenate([_responses(x, bank, w).max(axis=1) for bank, w in zip(banks, WIDTHS, strict=True)], axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def window_probs(m: Model, x: np.ndarray, banks: list | None = None, step: int = 192) -> np.ndarray:
    banks = banks or _tables(m.filters)
    out = np.empty((len(x), len(m.langs)), dtype=np.float32)
    for k in range(0, len(x), step):
        h = np.maximum(pooled(m, x[k : k + step], banks) + m.bias, 0)
        out[k : k + step] = softmax(h @ m.out + m.out_bias)
    return out


def fit(x: np.ndarray, y: np.ndarray, langs: tuple[str, ...], epochs: int = 5, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the cross entropy; a third of the windows are cut short, so that short texts are learnt too."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
    for p in params:
        p[:, PAD] = -1.0
    params += [np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, total = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), batch):
            rows = order[k : k + batch]
            xb, yb = x[rows].copy(), y[rows]
            for r in range(0, len(rows), 3):
                xb[r, int(rng.integers(4, WINDOW)) :] = PAD
            grads = [np.zeros_like(p) for p in params]
            pools, places = [], []
            for bank, w in zip(_tables(tuple(params[:3])), WIDTHS, strict=True):
                resp = _responses(xb, bank, w)
                at = resp.argmax(axis=1)
                places.append(at)
                pools.append(np.take_along_axis(resp, at[:, None, :], axis=1)[:, 0])
            pre = np.concatenate(pools, axis=1) + params[3]
            h = np.maximum(pre, 0)
            p = softmax(h @ params[4] + params[5])
            p[np.arange(len(yb)), yb] -= 1
            p /= len(yb)
            grads[4], grads[5] = h.T @ p, p.sum(axis=0)
            back = (p @ params[4].T) * (pre > 0)
            grads[3] = back.sum(axis=0)
            f = np.arange(FILTERS)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(w):
                    byte = np.take_along_axis(xb, places[i] + j, axis=1)
                    np.add.at(grads[i][j], (byte, np.broadcast_to(f, byte.shape)), g)
                grads[i][:, PAD] = 0
            step += 1
            lr = rate * (1 - 0.9 * step / total)
            for q, g, a, b in zip(params, grads, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                q -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Model(langs, tuple(params[:3]), params[3], params[4], params[5])


def learn(docs: DataFrame, usable: Column | None = None, most: int = TRAIN_DOCS) -> Model | None:
    """A model from at most `most` labelled documents, of rows that repeat an id the least text; only text and lang are learnt from."""
    rows = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    if usable is not None:
        rows = rows.where(usable)
    rows = rows.select("doc_id", "text", "lang")
    ids = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = rows.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.text", "r.lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            x, doc, length = cut_windows(c.buf, c.off)
            nth = np.arange(len(doc)) - np.searchsorted(doc, doc)
            count = A.per_doc(doc, len(c.off) - 1)[doc]
            keep = np.flatnonzero((nth * TRAIN_WINDOWS // np.maximum(count, 1) != (nth - 1) * TRAIN_WINDOWS // np.maximum(count, 1)) & (length >= 8))
            rows = pa.array([x[k].tobytes() for k in keep], pa.binary())
            take = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays([c.ids.take(take), c.rows.column(2).take(take), pa.array(nth[keep]), rows], names=["doc_id", "lang", "nth", "x"])

    got = picked.transform(ready).mapInArrow(cut, "doc_id long, lang string, nth long, x binary").toPandas()
    if got.empty:
        return None
    got = got.sort_values(["doc_id", "nth", "lang"], kind="stable")
    langs = tuple(sorted(got["lang"].unique()))
    x = np.frombuffer(b"".join(got["x"]), dtype=np.uint8).reshape(-1, WINDOW)
    return fit(x, np.searchsorted(np.array(langs, dtype=object), got["lang"].to_numpy()), langs)


def _has_letter(c: A.Chunk, k: int) -> bool:
    raw = c.buf[c.off[k] : c.off[k + 1]]
    return bool(LETTER[raw].any()) or any(ch.isalpha() for ch in raw.tobytes().decode("utf-8", "replace"))


def chunk_languages(c: A.Chunk, model: Model | None, banks: list) -> tuple[list[str], np.ndarray]:
    """Language and score of each document of a chunk."""
    n = len(c.off) - 1
    lang, score = [UNKNOWN] * n, np.zeros(n)
    if model and len(c.buf):
        x, doc, length = cut_windows(c.buf, c.off)
        p = window_probs(model, x, banks)
        total = np.stack([np.bincount(doc, weights=length * p[:, k], minlength=n) for k in range(len(model.langs))], axis=1)
        total /= np.maximum(c.off[1:] - c.off[:-1], 1)[:, None]
        best = total.argmax(axis=1)
        for k in range(n):
            if c.off[k + 1] > c.off[k] and _has_letter(c, k):
                lang[k], score[k] = model.langs[best[k]], min(1.0, float(total[k, best[k]]))
    return lang, score


def with_language(docs: DataFrame, model: Model | None, lang_column: str = "lang_pred", score_column: str = "score") -> DataFrame:
    """All columns of docs, with language and score appended in one pass under names that docs doesn't have."""
    if clash := {lang_column.lower(), score_column.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {', '.join(sorted(clash))}; name other ones")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        banks = _tables(model.filters) if model else []
        for c in A.chunks(batches):
            lang, score = chunk_languages(c, model, banks)
            yield pa.RecordBatch.from_arrays([*c.rows.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*c.rows.schema.names, lang_column, score_column])

    return docs.transform(ready).mapInArrow(run, type(docs.schema)(docs.schema.fields + [StructField(lang_column, StringType()), StructField(score_column, DoubleType())]))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    return with_language(docs.select("doc_id", "text"), model).drop("text")
