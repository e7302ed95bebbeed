"""Which windows of a fixed length occur more than once, found level by level.

A window of `length` units (words or bytes) can only repeat if every shorter
window inside it does. A level looks at windows of one shorter length, but of
each full window only at those that are least in a hash among its parts
(minimizers), so that two equal full windows look at the same parts. Parts that
occur once are dead; full windows that look at a dead part are given up, and the
next level takes parts of about twice the length from the rest only.

Counting is a grouped count with map-side sums and a semi-join, on hashes; texts
are moved once, and after that only those that still have candidates. Texts
equal as a whole are counted by digest beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ready
from . import arrays as A
from .common import forget, long_ids, stored


class Units(NamedTuple):
    """The units of a chunk: sums for run hashes, each unit's document, each document's first unit."""

    sums: np.ndarray
    doc: np.ndarray
    first: np.ndarray


class Kind(NamedTuple):
    """What a window is made of, how long it is, and the lengths of the levels before it."""

    units: Callable[[np.ndarray, np.ndarray], Units]
    digest: Callable[[np.ndarray, np.ndarray], list[str]]
    length: int
    levels: tuple[int, ...]


def word_units(buf: np.ndarray, off: np.ndarray) -> Units:
    starts, ends, doc = A.word_bounds(buf, off)
    return Units(A.prefix(A.bytes_hash(buf, starts, ends)), doc, A.word_offsets(doc, len(off) - 1))


def byte_units(buf: np.ndarray, off: np.ndarray) -> Units:
    return Units(A.prefix(A.BYTE_CODE[buf]), np.repeat(np.arange(len(off) - 1), np.diff(off)), off)


def word_digest(buf: np.ndarray, off: np.ndarray) -> list[str]:
    raw, cuts = buf.tobytes(), off.tolist()
    return [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def byte_digest(buf: np.ndarray, off: np.ndarray) -> list[str]:
    raw, cuts = buf.tobytes(), off.tolist()
    return [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def full_windows(u: Units, length: int) -> np.ndarray:
    """For each unit: does a full window within one document start there?"""
    n = len(u.doc)
    out = np.zeros(n, dtype=bool)
    if n >= length:
        out[: n - length + 1] = u.doc[: n - length + 1] == u.doc[length - 1 :]
    return out


def parts(u: Units, k: Kind, level: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of one level that the given full windows look at.

    A window looks at the least part in each of `level + 1` equal stretches of
    itself. Returns their places per stretch for every window, all places once,
    and their hashes.
    """
    size, n, stretches = k.levels[level], len(u.doc), level + 1
    starts = k.length - size + 1
    place = np.zeros((stretches, max(n - k.length + 1, 0)), dtype=np.int64)
    if n >= k.length:
        codes = A.order_codes(u.sums, size)
        for j in range(stretches):
            begin, end = j * starts // stretches, (j + 1) * starts // stretches
            place[j] = A.minimizers(codes, end - begin)[begin : begin + place.shape[1]]
    used = np.zeros(n, dtype=bool)
    used[place[:, np.flatnonzero(windows)].ravel()] = True
    places = np.flatnonzero(used)
    return place, places, A.run_hash(u.sums, places, places + size)


def survivors(u: Units, k: Kind, alive: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Full windows whose parts of the levels done all live, and each window's part of the first level; alive has, per level, the documents' living places and their bounds."""
    windows = full_windows(u, k.length)
    first = np.zeros(0, dtype=np.int64)
    for level, (values, bounds) in enumerate(alive):
        place, _, _ = parts(u, k, level, windows)
        first = first if level else place[0]
        lives = np.zeros(len(u.doc), dtype=bool)
        lives[u.first[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] + values] = True
        at = np.flatnonzero(windows)
        windows[at] = lives[place[:, at]].all(axis=0)
    return windows, first


def first_level(docs: DataFrame, k: Kind) -> DataFrame:
    """Per document its count of units, digest, and the hashes and places of its parts of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            n = len(c.off) - 1
            u = k.units(c.buf, c.off)
            _, places, codes = parts(u, k, 0, full_windows(u, k.length))
            owner = u.doc[places]
            yield pa.RecordBatch.from_arrays(
                [c.ids, c.rows.column(1), pa.array(np.diff(u.first)), pa.array(k.digest(c.buf, c.off)), A.list_array(codes.view(np.int64), owner, n, pa.int64()), A.list_array((places - u.first[owner]).astype(np.int32), owner, n, pa.int32())],
                names=["doc_id", "v", "n", "digest", "h", "p"],
            )

    return keyed(docs).transform(ready).mapInArrow(run, "doc_id long, v long, n long, digest string, h array<long>, p array<int>")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a checksum of the text (so that repeated ids stay apart; it goes with every candidate, and at 64 bits costs the budget of disk), and the text, empty for null. Rows without a doc_id are left out."""
    return docs.where("doc_id IS NOT NULL").transform(long_ids).select("doc_id", F.crc32(F.coalesce("text", F.lit(""))).alias("v"), F.coalesce("text", F.lit("")).alias("text"))


def repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """doc_id, v and `name`: the places of the rows whose key occurs more than once."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    # as new columns the keys are shuffled once more (few are left), which lets Spark split a skewed key in the join
    twice = twice.select(*[F.col(k).bitwiseXOR(F.lit(0)).alias(k) for k in keys])
    return rows.join(twice, keys, "left_semi").groupBy("doc_id", "v").agg(F.collect_list("p").alias(name))


def next_level(texts: DataFrame, k: Kind, done: int) -> DataFrame:
    """Rows h, doc_id, v, p: parts of the next level of each text's remaining windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            u = k.units(c.buf, c.off)
            left, _ = survivors(u, k, [A.lists(c.rows.column(f"a{i}")) for i in range(done)])
            _, places, codes = parts(u, k, done, left)
            owner = u.doc[places]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), c.ids.take(take), c.rows.column("v").take(take), pa.array((places - u.first[owner]).astype(np.int32))], names=["h", "doc_id", "v", "p"])

    return texts.transform(ready).mapInArrow(run, "h long, doc_id long, v long, p int")


def candidates(docs: DataFrame, k: Kind) -> tuple[DataFrame, DataFrame]:
    """(per document: count, digest, copies; the texts with windows left and their living places a0, a1, ...)."""
    seen = stored(first_level(docs, k), "parts")
    same = seen.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "v")).alias("one"))
    same = same.withColumn("digest", F.substring("digest", 1, 64))  # a new column, as in repeated()
    base = stored(seen.select("doc_id", "v", "n", "digest").join(same, "digest"), "copies")
    # of equal texts one is enough to find what others share with them
    one = base.where("copies = 1 OR (one.doc_id = doc_id AND one.v = v)").select("doc_id", "v").distinct()
    rows = seen.join(one, ["doc_id", "v"], "left_semi").select("doc_id", "v", F.explode(F.arrays_zip("h", "p")).alias("x")).select("x.h", "doc_id", "v", "x.p")
    # a shuffle of the texts whatever the other side's size, so that the plan doesn't change with the input
    texts = stored(keyed(docs).join(repeated(rows, ["h"], "a0").hint("shuffle_hash"), ["doc_id", "v"]), "texts")
    forget(seen)
    for done in range(1, len(k.levels)):
        found = repeated(next_level(texts, k, done), ["h"], f"a{done}")
        kept = stored(texts.join(found, ["doc_id", "v"]), "texts")
        forget(texts)
        texts = kept
    return base, texts


def finish(base: DataFrame, judged: DataFrame, k: Kind, empty: str, extra: str) -> DataFrame:
    """Results of all documents: wholly removed if the text occurs twice, as judged, or unchanged."""
    whole = (F.col("copies") > 1) & (F.col("n") >= k.length)
    judged = judged.dropDuplicates(["doc_id", "v"])
    out = base.join(judged, ["doc_id", "v"], "left")
    return out.select(
        "doc_id",
        "n",
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce(extra, F.lit(0))).cast("long").alias(extra),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )
