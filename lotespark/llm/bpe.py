"""BPE encoding and decoding in batched numpy merge rounds.

A chunk's texts are normalised and cut into pre-tokens, and each different
pre-token is encoded once: the symbols of all of them stand in one flat array,
a round looks up every neighbouring pair by binary search among the sorted pair
keys, finds each word's lowest rank, and merges all its places. Words without a
known pair leave the array. Ids, decimal digits and decoded tokens are made per
different pre-token and joined per document.

Special tokens found in a text become their ids, as the tokenizer does; a null
text counts as empty, and an empty one has no tokens and decodes to nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ready
from . import arrays as A
from . import pretoken
from .common import long_ids

FAR = np.int64(1 << 40)
CHUNK = 1 << 20


class Vocabulary:
    """Merge table and token strings of a word-style tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.cache = pretoken.word_cache(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        letters = pretoken.byte_letters()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int64)
        self.token = [b""] * self.size
        for text, k in [*vocab.items(), *self.special.items()]:
            self.token[k] = text.encode()
        self.digits = [b"%d" % k for k in range(self.size)]
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normal(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def merge_rounds(v: Vocabulary, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words given as flat bytes, and how many ids each word has."""
    n = len(size)
    word = np.repeat(np.arange(n), size)
    sym = v.inner[raw]
    last = np.cumsum(size) - 1
    sym[last] = v.final[raw[last]]
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(sym):
        key = np.full(len(sym), -1, dtype=np.int64)
        same = word[1:] == word[:-1]
        key[:-1][same] = sym[:-1][same] * v.size + sym[1:][same]
        at = np.minimum(np.searchsorted(v.key, key), len(v.key) - 1)
        rank = np.where(v.key[at] == key, v.rank[at], FAR)
        first = np.flatnonzero(np.append(True, ~same))
        least = np.minimum.reduceat(rank, first)
        count = np.diff(np.append(first, len(sym)))
        least = np.repeat(least, count)
        over = least == FAR
        if over.any():
            done.append((word[over], sym[over]))
            live = ~over
            word, sym, at, rank, least = word[live], sym[live], at[live], rank[live], least[live]
            if not len(sym):
                break
        hit = rank == least
        if (hit[1:] & hit[:-1]).any():  # a pair of equal symbols overlaps itself: take every other place from the left
            place = np.arange(len(hit))
            run = place - np.maximum.accumulate(np.where(hit, -1, place))
            hit &= run % 2 == 1
        where = np.flatnonzero(hit)
        sym[where] = v.made[at[where]]
        keep = np.ones(len(sym), dtype=bool)
        keep[where + 1] = False
        word, sym = word[keep], sym[keep]
    if not done:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    words, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(words, kind="stable")
    return ids[order], np.bincount(words, minlength=n)


def encode_chunk(v: Vocabulary, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Per text the numbers of its pieces; ids of all pieces and where each piece's ids start."""
    pieces, owner, marks = [], [], {}
    for k, text in enumerate(texts):
        if v.cut is not None and "<|" in text and v.cut.search(text):
            parts = v.cut.split(text)
            marks[k] = [(len(pieces) + i // 2, v.special[p]) for i, p in enumerate(parts) if i % 2]
            parts = parts[::2]
        else:
            parts = [text]
        pieces += [normal(p) for p in parts]
        owner += [k] * len(parts)
    cp, off = pretoken.code_points(pieces)
    start, end, piece = pretoken.split(cp, off, "word")
    if len(start):
        code, first, number = pretoken.distinct(cp, start, end)

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s, e = start[first[new]], end[first[new]]
            chars = cp[A.ranges(s, e - s)]
            wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            raw = np.frombuffer(chars.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
            return merge_rounds(v, raw, np.add.reduceat(wide, np.concatenate([[0], np.cumsum(e - s)[:-1]])))

        ids, count = v.cache.ids(code, make)
    else:
        number, ids, count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    special = sorted(v.special.values())
    n = len(count)
    ids, count = np.append(ids, special).astype(np.int64), np.append(count, np.ones(len(special), np.int64)).astype(np.int64)
    bounds = np.searchsorted(piece, np.arange(len(pieces) + 1))
    out, at = [], 0
    for k in range(len(texts)):
        if k not in marks:
            out.append(number[bounds[at] : bounds[at + 1]])
            at += 1
            continue
        after = dict(marks[k])
        seq: list[int] = []
        while at < len(owner) and owner[at] == k:
            seq += number[bounds[at] : bounds[at + 1]].tolist()
            if at in after:
                seq.append(n + special.index(after[at]))
            at += 1
        out.append(np.array(seq, dtype=np.int64))
    return out, ids, np.concatenate([[0], np.cumsum(count)])


def encode(path: str, text: str) -> list[int]:
    v = vocabulary(path)
    (seq,), ids, at = encode_chunk(v, [text])
    return ids[A.ranges(at[seq], at[seq + 1] - at[seq])].tolist()


def decode(path: str, ids: list[int]) -> str:
    """Tokens of the ids, joined as a tokenizer without a decoder joins them."""
    v = vocabulary(path)
    return b" ".join([v.token[k] for k in ids]).decode()


def _texts(c: A.Chunk) -> list[str]:
    raw, off = c.buf.tobytes(), c.off.tolist()
    return [raw[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)]


def digests(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, and digests of the decimal ids and of the text decoded from them, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for c in A.chunks(batches, most=CHUNK):
            seqs, ids, at = encode_chunk(v, _texts(c))
            bounds, flat = at.tolist(), ids.tolist()
            digits = [b" ".join([v.digits[k] for k in flat[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            tokens = [b" ".join([v.token[k] for k in flat[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            size = np.diff(at)
            count, id_sha, text_sha = [], [], []
            for seq in seqs:
                count.append(int(size[seq].sum()))
                places = seq.tolist()
                id_sha.append(hashlib.sha256(b" ".join([digits[k] for k in places])).hexdigest())
                text_sha.append(hashlib.sha256(b" ".join([tokens[k] for k in places])).hexdigest())
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(count, pa.int64()), pa.array(id_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").transform(long_ids).transform(ready).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, token ids, and the digest of the text decoded from them, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for c in A.chunks(batches, most=CHUNK):
            seqs, ids, at = encode_chunk(v, _texts(c))
            bounds, flat = at.tolist(), ids.tolist()
            tokens = [b" ".join([v.token[k] for k in flat[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            rows = [ids[A.ranges(at[s], at[s + 1] - at[s])].astype(np.int32) for s in seqs]
            size = np.array([len(r) for r in rows])
            text_sha = [hashlib.sha256(b" ".join([tokens[k] for k in seq.tolist()])).hexdigest() for seq in seqs]
            values = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(np.concatenate(rows), pa.int32()))
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(size, pa.int64()), values, pa.array(text_sha)], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return docs.select("doc_id", "text").transform(long_ids).transform(ready).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
