"""Token-id files in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents. Its ids are cut into blocks of
128; a block stores its minimum, and the differences to it packed at the width
that holds nine in ten of them; wider ones keep their low bits in place and
their high bits in an exception list. An index has each block's start, so that
`block` reads one alone.

Layout, little endian: `PFR1`, counts of ids, blocks and exceptions (3 x u32);
per block its minimum (u32), width (u8), start in the packed bytes (u64) and
first exception (u32); exceptions as position in the segment (u32) and high
bits (u32); packed bytes, each block padded to whole bytes.

Segments are rows of a table written by Spark, so files go wherever Spark can
write; `part` and `seq` give their order. Null and empty texts are documents
with the end id alone. Rows of one doc_id are ordered by a hash of their text, so
their places don't change from run to run; rows without a doc_id come first.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..runtime import ready
from . import arrays as A
from . import pretoken
from .common import long_ids, stored

BLOCK = 128
SEGMENT_IDS = 1 << 18
PERCENTILE = 0.9
MAGIC = b"PFR1"
END_ID = 0
CHUNK = 1 << 20
WORDS_AT_ONCE = 1000


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each value; 0 for 0."""
    return np.where(x > 0, np.frexp(x.astype(np.float64))[1], 0).astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, dtype=np.int64)
    full[:n] = ids
    if n:
        full[n:] = ids[-1]
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1) if blocks else np.zeros(0, np.int64)
    rest = full - least[:, None]
    width = _bits(np.sort(rest, axis=1)[:, int(BLOCK * PERCENTILE)]) if blocks else np.zeros(0, np.int64)
    high = rest >> width[:, None]
    row, col = np.nonzero(high)
    real = row * BLOCK + col < n
    row, col = row[real], col[real]
    start = np.concatenate([[0], np.cumsum(width * (BLOCK // 8))])
    packed = np.zeros(int(start[-1]), dtype=np.uint8)
    low = (rest & ((1 << width) - 1)[:, None]).astype(np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        bits = (low[which][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
        packed[start[which][:, None] + np.arange(w * BLOCK // 8)] = np.packbits(bits.astype(np.uint8).reshape(len(which), -1), axis=1, bitorder="little")
    first_exc = np.searchsorted(row, np.arange(blocks))
    return b"".join([
        MAGIC, np.array([n, blocks, len(row)], "<u4").tobytes(),
        least.astype("<u4").tobytes(), width.astype("u1").tobytes(), start[:-1].astype("<u8").tobytes(), first_exc.astype("<u4").tobytes(),
        (row * BLOCK + col).astype("<u4").tobytes(), high[row, col].astype("<u4").tobytes(), packed.tobytes(),
    ])


def unpack(data: bytes) -> np.ndarray:
    """All ids of a segment, little-endian u32."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks, exceptions = np.frombuffer(data, "<u4", 3, 4).tolist()
    at = 16

    def part(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    least, width, start = part("<u4", blocks), part("u1", blocks), part("<u8", blocks)
    part("<u4", blocks)
    where, high = part("<u4", exceptions), part("<u4", exceptions)
    packed = np.frombuffer(data, np.uint8, -1, at)
    out = np.zeros((blocks, BLOCK), dtype="<u4")
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        raw = packed[start[which].astype(np.int64)[:, None] + np.arange(w * BLOCK // 8)]
        bits = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(which), BLOCK, w)
        value = np.zeros((len(which), BLOCK), dtype="<u4")
        for k in range(w):
            value |= bits[:, :, k].astype("<u4") << np.uint32(k)
        out[which] = value
    out = out.reshape(-1)
    if exceptions:
        out[where] |= high << width[where // BLOCK].astype("<u4")
    out += np.repeat(least, BLOCK)
    return out[:n]


def block(data: bytes, k: int) -> np.ndarray:
    """The ids of block k of a segment, by the index: the block's own bytes and exceptions are all that is read beside it."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, blocks, exceptions = np.frombuffer(data, "<u4", 3, 4).tolist()
    if not 0 <= k < blocks:
        raise IndexError(f"block {k} of {blocks}")
    index = 16 + np.concatenate([[0], np.cumsum([4 * blocks, blocks, 8 * blocks, 4 * blocks, 4 * exceptions, 4 * exceptions])])
    one = lambda part, kind, at, count=1: np.frombuffer(data, kind, count, int(index[part]) + at * np.dtype(kind).itemsize)
    least, width, start = (int(one(p, kind, k)[0]) for p, kind in ((0, "<u4"), (1, "u1"), (2, "<u8")))
    first = int(one(3, "<u4", k)[0])
    end = int(one(3, "<u4", k + 1)[0]) if k + 1 < blocks else exceptions
    raw = np.frombuffer(data, np.uint8, width * BLOCK // 8, int(index[6]) + start)
    bits = np.unpackbits(raw, bitorder="little").reshape(BLOCK, width).astype(np.uint64)
    out = (bits << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    where, high = one(4, "<u4", first, end - first), one(5, "<u4", first, end - first)
    out[where - k * BLOCK] |= high.astype(np.uint64) << np.uint64(width)
    return (out + np.uint64(least)).astype("<u4")[: n - k * BLOCK]


def encode_texts(tok_path: str, texts: list[str], special: tuple[str, ...], cache: pretoken.WordCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, each text's closed by END_ID, and the count of each; equal pre-tokens are encoded once."""
    tok = tokenizer_of(tok_path)
    plain = [k for k, t in enumerate(texts) if not any(s in t for s in special)]
    own = {k: np.array(e.ids, dtype=np.int64) for k, e in zip(rest, tok.encode_batch([texts[k] for k in rest], add_special_tokens=False), strict=True)} if (rest := sorted(set(range(len(texts))) - set(plain))) else {}
    cp, off = pretoken.code_points([texts[k] for k in plain])
    start, end, piece = pretoken.split(cp, off, "byte")
    if len(start):
        code, first, number = pretoken.distinct(cp, start, end)

        def make(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s, e = start[first[new]], end[first[new]]
            words = pretoken.strings(cp, s, e)
            runs = tok.encode_batch_fast([words[k : k + WORDS_AT_ONCE] for k in range(0, len(words), WORDS_AT_ONCE)], is_pretokenized=True, add_special_tokens=False)
            flat = np.fromiter(chain.from_iterable(r.ids for r in runs), np.int64)
            # a byte-level token has a letter for each of its bytes, so byte counts tell where words end
            chars = cp[A.ranges(s, e - s)]
            wide = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            ends = np.cumsum(wide)[np.cumsum(e - s) - 1]
            return flat, np.diff(np.searchsorted(np.cumsum(token_bytes(tok_path)[flat]), ends, "right"), prepend=0)

        flat, size = cache.ids(code, make)
    else:
        number, size, flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # one closing id after each text: a piece that no text has
    bounds = np.searchsorted(piece, np.arange(len(plain) + 1))
    seq = np.insert(number, bounds[1:], len(size))
    size, flat = np.append(size, 1), np.append(flat, END_ID)
    at = np.cumsum(size) - size
    ids = flat[A.ranges(at[seq], size[seq])]
    sums = np.concatenate([[0], np.cumsum(size[seq])])
    count = sums[bounds[1:] + np.arange(1, len(plain) + 1)] - sums[bounds[:-1] + np.arange(len(plain))]
    if not own:
        return ids, count
    parts, at = [], np.concatenate([[0], np.cumsum(count)])
    where = {k: i for i, k in enumerate(plain)}
    for k in range(len(texts)):
        parts.append(ids[at[where[k]] : at[where[k] + 1]] if k in where else np.append(own[k], END_ID))
    return np.concatenate(parts), np.array([len(p) for p in parts])


@lru_cache(maxsize=2)
def tokenizer_of(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=2)
def token_bytes(path: str) -> np.ndarray:
    """Length in bytes of each token of a byte-level vocabulary."""
    vocab = tokenizer_of(path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
    out[list(vocab.values())] = [len(t) for t in vocab]
    return out


SEGMENT_DDL = "part int, ahead long, n_ids long, unnamed long, doc_ids binary, sizes binary, payload binary"


def write_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Tokenise all documents and write them as segments in ascending doc_id; the table of the files. `unnamed` counts a segment's first documents, which have no doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cache = tokenizer_of(tokenizer), pretoken.word_cache(tokenizer)
        special = tuple(t.content for t in tok.get_added_tokens_decoder().values())
        part, ahead = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []

        def segment() -> pa.RecordBatch:
            nonlocal ahead, held
            keys, sizes, ids = (np.concatenate([h[k] for h in held]) for k in range(3))
            row = [[part], [ahead], [len(ids)], [sum(h[3] for h in held)], [keys.astype("<i8").tobytes()], [sizes.astype("<i8").tobytes()], [pack(ids)]]
            held, ahead = [], ahead + len(ids)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=["part", "ahead", "n_ids", "unnamed", "doc_ids", "sizes", "payload"])

        for c in A.chunks(batches, most=CHUNK):
            raw, off = c.buf.tobytes(), c.off.tolist()
            ids, count = encode_texts(tokenizer, [raw[a:b].decode() for a, b in zip(off[:-1], off[1:], strict=True)], special, cache)
            keys, unnamed = c.ids.fill_null(0).to_numpy(zero_copy_only=False), c.ids.null_count
            at, first = np.concatenate([[0], np.cumsum(count)]), 0
            while first < len(keys):  # whole documents, up to about SEGMENT_IDS ids
                room = SEGMENT_IDS - sum(len(h[2]) for h in held)
                end = max(first + 1, int(np.searchsorted(at, at[first] + max(room, 0), "right")) - 1)
                held.append((keys[first:end], count[first:end], ids[at[first] : at[end]], max(0, min(end, unnamed) - first)))
                first = end
                if sum(len(h[2]) for h in held) >= SEGMENT_IDS or first < len(keys):
                    yield segment()
        if held:
            yield segment()

    order = ["doc_id", F.xxhash64("text")]  # the lesser order too, so that a doc_id that many rows have is no single partition
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).transform(long_ids).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(rows.transform(ready).mapInArrow(run, SEGMENT_DDL), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files.

    A segment tells how many ids its part holds before it; the parts' own starts
    are a row for each partition of the writer, a written table by whose size
    Spark chooses how to join it.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = stored(parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")), "token-parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                base, unnamed, keys, sizes, payload = (batch.column(n)[k].as_py() for n in ("base", "unnamed", "doc_ids", "sizes", "payload"))
                ids = unpack(payload)
                keys, sizes = np.frombuffer(keys, "<i8"), np.frombuffer(sizes, "<i8")
                at = np.concatenate([[0], np.cumsum(sizes)])
                raw = memoryview(np.ascontiguousarray(ids)).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=np.arange(len(keys)) < unnamed), pa.array(at[:-1] + base), pa.array(sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = files.join(before, "part").select((F.col("before") + F.col("ahead")).alias("base"), "unnamed", "doc_ids", "sizes", "payload")
    return rows.transform(ready).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
