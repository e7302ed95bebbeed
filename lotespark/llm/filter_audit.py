"""Filter interaction audit: what each filter removes, in every order of the filters.

`flag_texts` finds, per document, which of the five filters it fails. `subset_counts`
packs failures and labels of a partition into bit sets, one run of bytes per part,
and counts by AND-NOT and popcount what is left after each of the 32 subsets of
filters; the partitions' counts are summed. A step of an order needs only the subset
of filters before it, so `report` reads all 120 orders from these counts.

Filters: A fewer than 200 words; B fewer distinct words than half the words; C more
than 2 % capitals; D holds one of `#$%&*|`; E equals the text of a smaller doc_id.

A null or empty text has no words, fails A and no other filter but E: it equals other
null and empty texts. A null doc_id is smaller than none and larger than none. Of rows
that repeat a doc_id none is smaller. A null source is the empty part. Labels of a
doc_id that several rows give count if any row gives them. An empty table has no parts
and so no rows. Other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ready
from . import arrays as A
from .common import stored

FILTERS = "ABCDE"
N = len(FILTERS)
SUBSETS = 1 << N
#: A and B in words, C in per cent of code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Parts that a task holds counts of before it passes them on.
HELD_PARTS = 4096

MARK = np.zeros(256, dtype=bool)
MARK[list(b"#$%&*|")] = True
CAPITAL = np.zeros(256, dtype=bool)
CAPITAL[0x41:0x5B] = True


def distinct_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Different words of each document, by the words themselves and not by hashes of them."""
    if not len(starts):
        return np.zeros(n, dtype=np.int64)
    size = ends - starts
    bounds = np.concatenate([[0], np.cumsum(size)])
    letters = buf[A.ranges(starts, size)]
    words = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(doc * (int(code.max()) + 1) + code)
    return np.bincount(pairs // (int(code.max()) + 1), minlength=n)


def own_failures(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Failures of A to D, each a bit, of every document."""
    n = len(off) - 1
    starts, ends, doc = A.word_bounds(buf, off)
    words = A.per_doc(doc, n)

    def count(flag: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(flag, out=sums[1:])
        return sums[off[1:]] - sums[off[:-1]]

    fails = (
        words < LEAST_WORDS,
        100 * distinct_words(buf, starts, ends, doc, n) < LEAST_DISTINCT * words,
        100 * count(CAPITAL[buf]) > MOST_CAPITALS * count((buf & 0xC0) != 0x80),
        count(MARK[buf]) > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def flag_texts(docs: DataFrame) -> DataFrame:
    """doc_id, part, failing (a bit per filter, A the lowest) of every document; texts are read once and compared by SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            yield pa.RecordBatch.from_arrays([c.ids, *(c.rows.column(k) for k in ("part", "digest")), pa.array(own_failures(c.buf, c.off), pa.int32())], names=["doc_id", "part", "digest", "failing"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"))
    key = docs.schema["doc_id"].dataType.simpleString()
    seen = stored(rows.transform(ready).mapInArrow(run, f"doc_id {key}, part string, digest binary, failing int"), "audit-texts")
    # written first, so that the join shuffles both sides for itself and a text that many rows have can be split
    first = stored(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "audit-copies")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return seen.join(first, "digest", "left").select("doc_id", "part", (F.col("failing") + copy).alias("failing"))


def label_bits(labels: DataFrame) -> DataFrame:
    """doc_id, good and toxic of every labelled doc_id."""
    any_row = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(any_row("quality").alias("good"), any_row("toxic").alias("toxic"))


def packed(flags: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """A bit set of `size` bytes with the flagged rows' places set."""
    bits = np.zeros(size * 8, dtype=bool)
    bits[place] = flags
    return np.packbits(bits)


def part_counts(part: np.ndarray, parts: int, failing: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """[part, subset, (left, good left, toxic left)]: each part's rows that fail no filter of the subset.

    A part's rows have bits of their own run of bytes, the last byte filled up with
    zeros, so a part is a slice and no set is longer than the rows.
    """
    order = np.argsort(part, kind="stable")
    rows = np.bincount(part, minlength=parts)
    begin = np.concatenate([[0], np.cumsum(-(-rows // 8))])
    place = begin[part[order]] * 8 + np.arange(len(part)) - np.repeat(np.cumsum(rows) - rows, rows)
    sets = [packed(flags[order], place, begin[-1]) for flags in (np.ones(len(part), bool), good, toxic)]
    fails = [packed((failing[order] >> k) & 1 == 1, place, begin[-1]) for k in range(N)]
    out = np.zeros((parts, SUBSETS, 3), dtype=np.int64)
    any_of = [np.zeros(begin[-1], dtype=np.uint8)]
    for subset in range(SUBSETS):
        if subset:
            low = (subset & -subset).bit_length() - 1
            any_of.append(any_of[subset & (subset - 1)] | fails[low])
        for k, bits in enumerate(sets):
            out[:, subset, k] = np.add.reduceat(np.bitwise_count(bits & ~any_of[subset]).astype(np.int64), begin[:-1])
    return out


def subset_counts(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, subset, kept, good, toxic: rows of a part that fail no filter of the subset."""

    def rows_of(names: list[str], held: np.ndarray) -> pa.RecordBatch:
        n = len(names)
        cols = [pa.array(np.repeat(np.array(names, dtype=object), SUBSETS), pa.string()), pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), n))]
        return pa.RecordBatch.from_arrays(cols + [pa.array(held[:, :, k].ravel()) for k in range(3)], names=["part", "subset", "kept", "good", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            named = batch.column("part").dictionary_encode()
            names = named.dictionary.to_pylist()
            failing, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("failing", "good", "toxic"))
            for name, counts in zip(names, part_counts(named.indices.to_numpy().astype(np.int64), len(names), failing, good, toxic)):
                held[name] = held[name] + counts if name in held else counts
            if len(held) >= HELD_PARTS:
                yield rows_of(list(held), np.stack(list(held.values())))
                held = {}
        if held:
            yield rows_of(list(held), np.stack(list(held.values())))

    rows = flagged.join(stored(label_bits(labels), "audit-labels"), "doc_id", "left")
    rows = rows.select("part", "failing", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    counts = rows.transform(ready).mapInArrow(run, "part string, subset int, kept long, good long, toxic long")
    return counts.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, number of its filter, subset of the filters before it)."""
    return [("".join(order), k + 1, FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k])) for order in permutations(FILTERS) for k in range(N)]


def report(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, read from the part's 32 counts."""
    listed = F.sort_array(F.collect_list(F.struct("subset", "kept", "good", "toxic")))  # 32 entries
    parts = counts.groupBy("part").agg(listed.alias("c")).select("part", *(F.col(f"c.{k}").alias(k) for k in ("kept", "good", "toxic")))
    left = lambda k, subset: F.col(k)[F.lit(subset)]
    lost = lambda k, before, f: left(k, before) - left(k, before | 1 << f)

    def shapley(f: int):
        others = [s for s in range(SUBSETS) if not s >> f & 1]
        return sum((lost("kept", s, f) * (factorial(s.bit_count()) * factorial(N - 1 - s.bit_count())) for s in others), F.lit(0))

    per_filter = F.array(*(F.struct((left("kept", 0) - left("kept", 1 << f)).alias("fails"), lost("kept", (SUBSETS - 1) ^ 1 << f, f).alias("only"), shapley(f).alias("shapley")) for f in range(N)))
    every = ", ".join(f"struct('{o}' AS filter_order, {k} AS step, {f} AS f, {s} AS before, {s | 1 << f} AS after)" for o, k, f, s in steps())
    rows = parts.withColumn("by_filter", per_filter).withColumn("at", F.explode(F.expr(f"array({every})")))
    own = F.col("by_filter")[F.col("at.f")]
    after = F.col("at.after")
    now = lambda k: F.col(k)[F.col("at.before")] - F.col(k)[after]
    return rows.select(
        "part", "at.filter_order", "at.step", F.col("kept")[after].alias("kept"), now("kept").alias("removed"), (own["fails"] - now("kept")).alias("redundant"),
        own["only"].alias("unique_fails"), now("good").alias("good_lost"), now("toxic").alias("toxic_lost"), own["shapley"].alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report over documents (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    return report(subset_counts(flag_texts(docs), labels))


#: The same in DuckDB: rows counted by the set of filters that they fail, then 120 orders of five steps over those sets.
SQL = """
WITH labelled AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY 1),
worded AS (
  SELECT t.*, f.first, regexp_extract_all(t.text, '[^\\x20\\x09-\\x0D]+') AS words FROM texts t JOIN firsts f USING (text)),
judged AS (
  SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
    (len(words) < 200)::INT AS A, (100 * len(list_distinct(words)) < 50 * len(words))::INT AS B,
    (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT AS C,
    regexp_matches(text, '[#$%&*|]')::INT AS D, coalesce(w.doc_id > w.first, false)::INT AS E
  FROM worded w LEFT JOIN labelled l USING (doc_id)),
sets AS (
  SELECT part, A + 2 * B + 4 * C + 8 * D + 16 * E AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS f, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
counted AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (fails & (before + f) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails & before = 0 AND fails & f > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & before > 0 AND fails & f > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails & before = 0 AND fails & f > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & f > 0), 0)::BIGINT AS toxic_lost
  FROM sets, steps GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley
FROM counted
"""
