"""Suffix-array dedup on a run-length index.

Byte strings of 400 that also start elsewhere, in the same document or another,
lose all their bytes. Two levels of shorter parts (64 and 200 bytes) give up
windows that cannot repeat; what is left of a document is cut into pieces, each
the windows that share one 64-byte part, so that equal strings are always in
pieces with the same part. Equal pieces are one row with a count. All different
pieces of a part meet in one task, which builds a run-length index of a block of
them, those that occur more than once twice, and reads off every position's
longest match elsewhere (rindex).

A part with more than GROUP different pieces is not gathered: its windows are
counted one by one on a 96-bit hash instead, which is exact too and has no
groups. A null or empty text has no bytes; repeated rows are further
occurrences; rows without a doc_id are left out. Matches never cross documents,
since pieces don't.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ready
from . import arrays as A
from . import repeats as R
from . import rindex
from .common import forget, stored

LENGTH = 400
BYTES = R.Kind(R.byte_units, R.byte_digest, LENGTH, (64, 200))
BLOCK_BYTES = 1 << 20
GROUP = 1500
EMPTY = hashlib.sha256(b"").hexdigest()
PIECE = ["h", "g1", "g2"]


def _chunk_pieces(c: A.Chunk, k: R.Kind) -> tuple[R.Units, np.ndarray, np.ndarray, np.ndarray]:
    """Units, first window and count of windows of each piece, and the hash of the part it shares."""
    u = k.units(c.buf, c.off)
    left, place = R.survivors(u, k, [A.lists(c.rows.column(f"a{i}")) for i in range(len(k.levels))])
    at = np.flatnonzero(left)
    mine = place[at]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (mine[1:] != mine[:-1]) | (u.doc[at[1:]] != u.doc[at[:-1]]))) if len(at) else at
    count = np.diff(np.append(first, len(at)))
    part = mine[first]
    return u, at[first], count, A.run_hash(u.sums, part, part + k.levels[0])


def _pieces(texts: DataFrame, k: R.Kind) -> DataFrame:
    """A row per piece: its part, two hashes of its bytes, where it is and how many windows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            u, start, count, h = _chunk_pieces(c, k)
            end = start + count + k.length - 1
            other = A.prefix(A.mix(A.BYTE_CODE[c.buf] ^ A.U(0x5851F42D4C957F2D)))
            owner = u.doc[start]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(A.run_hash(u.sums, start, end).view(np.int64)), pa.array(A.run_hash(other, start, end).view(np.int64)), c.ids.take(take), c.rows.column("v").take(take), pa.array((start - u.first[owner]).astype(np.int32)), pa.array(count.astype(np.int32))],
                names=[*PIECE, "doc_id", "v", "p", "n"],
            )

    return texts.transform(ready).mapInArrow(run, "h long, g1 long, g2 long, doc_id long, v long, p int, n int")


def _with_bytes(carriers: DataFrame, texts: DataFrame, k: R.Kind) -> DataFrame:
    """h, g1, g2, c and the bytes of each carrier piece, cut from its document."""
    held = carriers.groupBy("doc_id", "v").agg(F.collect_list(F.struct(*PIECE, "c", "p", "n")).alias("cut"))
    rows = texts.select("doc_id", "v", "text").join(held, ["doc_id", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            cut = c.rows.column("cut")
            bounds = cut.offsets.to_numpy().astype(np.int64)
            flat = cut.flatten()
            base = np.repeat(c.off[:-1], np.diff(bounds))
            raw = c.buf.tobytes()
            start = base + flat.field("p").to_numpy()
            end = start + flat.field("n").to_numpy() + k.length - 1
            data = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(flat.field(f) for f in (*PIECE, "c")), pa.array(data, pa.binary())], names=[*PIECE, "c", "data"])

    return rows.transform(ready).mapInArrow(run, "h long, g1 long, g2 long, c long, data binary")


def _matched(pieces: DataFrame, k: R.Kind) -> DataFrame:
    """For each piece the runs [lo, hi) of its windows that also start elsewhere in the pieces of its part, or in a copy of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            lo, hi = [], []
            again = [r[4] for r in held if r[3] > 1]  # another occurrence of an equal piece stands behind the block
            for found in rindex.long_matches([*(r[4] for r in held), *again], k.length)[: len(held)]:
                cuts = np.flatnonzero(found[1:] != found[:-1] + 1)
                lo.append(found[np.append(0, cuts + 1)].tolist() if len(found) else [])
                hi.append((found[np.append(cuts, len(found) - 1)] + 1).tolist() if len(found) else [])
            ints = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in held], pa.int64()) for i in range(3)), pa.array(lo, ints), pa.array(hi, ints)], names=[*PIECE, "lo", "hi"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in (*PIECE, "c", "data")), strict=True):
                if size >= BLOCK_BYTES and row[0] != held[-1][0]:  # a part's pieces stay together
                    yield block()
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) * (2 if row[3] > 1 else 1)
        if held:
            yield block()

    return pieces.repartition("h").sortWithinPartitions(*PIECE).transform(ready).mapInArrow(run, "h long, g1 long, g2 long, lo array<int>, hi array<int>")


def _window_rows(texts: DataFrame, hot: DataFrame, k: R.Kind) -> DataFrame:
    """Rows h, g, doc_id, v, p of every window of the pieces whose part is too common to gather."""
    held = hot.groupBy("doc_id", "v").agg(F.collect_list(F.struct("p", "n")).alias("cut"))
    rows = texts.select("doc_id", "v", "text").join(held, ["doc_id", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            cut = c.rows.column("cut")
            owner = np.repeat(np.arange(len(c.off) - 1), np.diff(cut.offsets.to_numpy().astype(np.int64)))
            flat = cut.flatten()
            count = flat.field("n").to_numpy().astype(np.int64)
            at = A.ranges(c.off[owner] + flat.field("p").to_numpy(), count)
            owner = np.repeat(owner, count)
            sums = A.prefix(A.BYTE_CODE[c.buf])
            other = A.prefix(A.mix(A.BYTE_CODE[c.buf] ^ A.U(0x5851F42D4C957F2D)))
            g = (A.run_hash(other, at, at + k.length) >> A.U(32)).astype(np.uint32).view(np.int32)
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(A.run_hash(sums, at, at + k.length).view(np.int64)), pa.array(g), c.ids.take(take), c.rows.column("v").take(take), pa.array((at - c.off[owner]).astype(np.int32))], names=["h", "g", "doc_id", "v", "p"])

    return rows.transform(ready).mapInArrow(run, "h long, g int, doc_id long, v long, p int")


def _cut(texts: DataFrame, k: R.Kind) -> DataFrame:
    """Results of the texts with runs [lo, hi) of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            n = len(c.off) - 1
            cut = c.rows.column("cut")
            owner = np.repeat(np.arange(n), np.diff(cut.offsets.to_numpy().astype(np.int64)))
            flat = cut.flatten()
            lo, hi = (c.off[owner] + flat.field(f).to_numpy() for f in ("lo", "hi"))
            step = np.bincount(lo, minlength=len(c.buf) + 1) - np.bincount(hi + k.length - 1, minlength=len(c.buf) + 1)
            gone = np.cumsum(step[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            opens = gone & np.append(True, ~gone[:-1])
            opens[c.off[:-1][c.off[:-1] < len(gone)]] |= gone[c.off[:-1][c.off[:-1] < len(gone)]]
            begins = np.concatenate([[0], np.cumsum(opens)])
            kept = c.buf[~gone].tobytes()
            at = (c.off - sums[c.off]).tolist()
            sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
            removed, spans = np.diff(sums[c.off]), np.diff(begins[c.off])
            yield pa.RecordBatch.from_arrays([c.ids, c.rows.column("v"), pa.array(removed), pa.array(spans), pa.array(sha)], names=["doc_id", "v", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("doc_id", "v", "text", "cut").transform(ready).mapInArrow(run, "doc_id long, v long, n_removed long, n_spans long, kept_sha256 string")


def suffix_dedup(docs: DataFrame, k: R.Kind = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    base, texts = R.candidates(docs, k)
    pieces = stored(_pieces(texts, k), "pieces")
    kinds = pieces.groupBy(*PIECE).agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "v", "p", "n")).alias("one"))
    kinds = stored(kinds, "kinds")
    parts = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.sum("c").alias("rows")).where("rows > 1")
    parts = stored(parts, "piece-parts")
    gathered = kinds.join(parts.where(F.col("kinds") <= GROUP).select("h"), "h").select(*PIECE, "c", "one.doc_id", "one.v", "one.p", "one.n")
    runs = stored(_matched(_with_bytes(gathered, texts, k), k), "runs").where(F.size("lo") > 0)
    found = pieces.join(runs, PIECE).select("doc_id", "v", "p", F.explode(F.arrays_zip("lo", "hi")).alias("x"))
    found = found.select("doc_id", "v", (F.col("p") + F.col("x.lo")).alias("lo"), (F.col("p") + F.col("x.hi")).alias("hi"))
    hot = pieces.join(parts.where(F.col("kinds") > GROUP).select("h"), "h", "left_semi")
    alone = R.repeated(_window_rows(texts, hot, k), ["h", "g"], "at").select("doc_id", "v", F.explode("at").alias("lo"))
    found = found.union(alone.select("doc_id", "v", "lo", F.col("lo") + 1)).groupBy("doc_id", "v").agg(F.collect_list(F.struct("lo", "hi")).alias("cut"))
    judged = stored(_cut(texts.select("doc_id", "v", "text").join(found, ["doc_id", "v"]), k), "judged")
    for done in (texts, pieces, kinds, parts, runs):
        forget(done)
    return R.finish(base, judged, k, EMPTY, "n_spans").withColumnRenamed("n", "n_bytes")
