"""Numpy helpers on Arrow text: flat byte buffers, word bounds, window hashes.

Tasks see a batch of documents as one flat UTF-8 buffer with offsets, so that
counting and hashing are vector operations and no Python object is made for a
word. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
BASE_INV = U(pow(int(BASE), -1, 1 << 64))

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Chunk(NamedTuple):
    """Some documents: ids, the bytes of all texts, and each text's start (one more at the end)."""

    ids: np.ndarray
    buf: np.ndarray
    off: np.ndarray
    rows: pa.RecordBatch


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column, nulls as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    big = pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string()
    col = pc.fill_null(col.cast(big), b"" if big == pa.large_binary() else "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", key: str = "doc_id", most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Slices of at most about `most` bytes of text; a longer document comes alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        buf, off = flat(batch.column(names.index(text)))
        ids = batch.column(names.index(key)) if key in names else None
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            rows = batch.slice(at, end - at)
            yield Chunk(None if ids is None else ids.slice(at, end - at), buf[off[at] : off[end]], off[at : end + 1] - off[at], rows)
            at = end
    give_back()


def give_back() -> None:
    """Return freed memory to the system, so that a worker between tasks holds little beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** i modulo 2 ** 64 for i below n; a worker keeps the longest list made so far."""
    base = int(BASE_INV if inverse else BASE)
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(1 << max(16, int(n - 1).bit_length()), base, dtype=U)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finalizer)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=U))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE ** i; slices of them give hashes of runs."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(len(values)) if len(values) else values, out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal runs wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums), inverse=True)[start] + (end - start).astype(U))


def order_codes(sums: np.ndarray, size: int) -> np.ndarray:
    """A code for each run of `size` values, equal for equal runs: run_hash without its last scramble, for choosing least ones."""
    out = sums[size:] - sums[:-size]
    out *= powers(len(sums), inverse=True)[: len(out)]
    out *= U(0xD6E8FEB86659FD93)
    return out


def bytes_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return run_hash(prefix(BYTE_CODE[buf]), start, end)


def word_bounds(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in buf of the words (by default `[^\\x20\\x09-\\x0D]+`), and each word's document."""
    word = ~space[buf]
    start = word.copy()
    start[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(buf))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_offsets(doc: np.ndarray, n: int) -> np.ndarray:
    """Index of each document's first word, with the count of all words at the end."""
    return np.searchsorted(doc, np.arange(n + 1))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, then those of the next, in one array."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    keep = size > 0
    start, size = start[keep].astype(np.int64), size[keep].astype(np.int64)
    out = np.ones(total, dtype=np.int64)
    first = np.cumsum(size)[:-1]
    out[0] = start[0]
    out[first] = start[1:] - (start[:-1] + size[:-1] - 1)
    return np.cumsum(out)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of `width` at one of the starts."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step[:-1]) > 0


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def minimizers(codes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` codes, the place of its least one (the first of equals)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    key = np.full(-(-len(codes) // width) * width, np.iinfo(np.uint64).max, dtype=U)
    key[: len(codes)] = (codes & U(0xFFFFFFFF00000000)) | np.arange(len(codes), dtype=U)
    blocks = key.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return (np.minimum(ahead[:n], behind[width - 1 : width - 1 + n]) & U(0xFFFFFFFF)).astype(np.int64)


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and int64 bounds of a list column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    off = col.offsets.to_numpy().astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), off - off[0]


def list_array(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """A list for each of n owners; owner is ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))
