"""Substring dedup by level-wise doubling.

Windows of 35 words whose word sequence also starts elsewhere, in the same
document or another, lose all their words. Lengths double: parts of 9 words
that occur twice or more are looked at again at 18 words, and what is left at
the full 35, where every remaining window is counted on a 96-bit hash. Windows
are judged on the input, so one pass over the last level's answer removes them.

A null or empty text has no words; texts under 35 words lose nothing; repeated
rows count as further occurrences; rows without a doc_id are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import ready
from . import arrays as A
from . import repeats as R
from .common import forget, stored

LENGTH = 35
WORDS = R.Kind(R.word_units, R.word_digest, LENGTH, (9, 18))
EMPTY = hashlib.sha256(b"").hexdigest()


def _full_level(texts: DataFrame, k: R.Kind) -> DataFrame:
    """Rows h, g, doc_id, v, p of every window left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            starts, ends, _ = A.word_bounds(c.buf, c.off)
            u = k.units(c.buf, c.off)
            at = np.flatnonzero(R.survivors(u, k, [A.lists(c.rows.column(f"a{i}")) for i in range(len(k.levels))])[0])
            other = A.prefix(A.mix(A.bytes_hash(c.buf, starts, ends) ^ A.U(0x5851F42D4C957F2D)))
            g = (A.run_hash(other, at, at + k.length) >> A.U(32)).astype(np.uint32).view(np.int32)
            owner = u.doc[at]
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([pa.array(A.run_hash(u.sums, at, at + k.length).view(np.int64)), pa.array(g), c.ids.take(take), c.rows.column("v").take(take), pa.array((at - u.first[owner]).astype(np.int32))], names=["h", "g", "doc_id", "v", "p"])

    return texts.transform(ready).mapInArrow(run, "h long, g int, doc_id long, v long, p int")


def _cut(texts: DataFrame, k: R.Kind) -> DataFrame:
    """doc_id, v, n_removed, n_spans and kept_sha256 of texts with repeated windows at `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            starts, ends, doc = A.word_bounds(c.buf, c.off)
            n = len(c.off) - 1
            first = A.word_offsets(doc, n)
            values, bounds = A.lists(c.rows.column("at"))
            owner = np.repeat(np.arange(n), np.diff(bounds))
            gone = A.covered(np.unique(first[owner] + values), k.length, len(doc))
            opens = gone & np.append(True, ~gone[:-1] | (doc[1:] != doc[:-1])) if len(gone) else gone
            raw, keep = c.buf.tobytes(), ~gone
            sha = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                mine = np.flatnonzero(keep[a:b]) + a
                sha.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(starts[mine].tolist(), ends[mine].tolist(), strict=True)])).hexdigest())
            yield pa.RecordBatch.from_arrays([c.ids, c.rows.column("v"), pa.array(A.per_doc(doc[gone], n)), pa.array(A.per_doc(doc[opens], n)), pa.array(sha)], names=["doc_id", "v", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("doc_id", "v", "text", "at").transform(ready).mapInArrow(run, "doc_id long, v long, n_removed long, n_spans long, kept_sha256 string")


def substring_dedup(docs: DataFrame, k: R.Kind = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans (runs of removed words) and kept_sha256 of every document."""
    base, texts = R.candidates(docs, k)
    found = R.repeated(_full_level(texts, k), ["h", "g"], "at")
    judged = stored(_cut(texts.select("doc_id", "v", "text").join(found, ["doc_id", "v"]), k), "judged")
    forget(texts)
    return R.finish(base, judged, k, EMPTY, "n_spans").withColumnRenamed("n", "n_words")
