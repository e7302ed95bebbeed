"""Quality rules: a learned decision list over text statistics.

`text_stats` counts, per whole text, what the rules look at. `fit_rules` learns
an ordered list of threshold conjunctions by sequential covering: each rule is
grown by information gain on two thirds of the rows that earlier rules leave,
pruned from its end on the other third, and kept while it is right in three of
five at least of all the rows that it takes. `rules_column` turns the list into one ordered Spark
conditional expression.

Null and empty texts have no words and fail the base rule. Statistics of a
document are made from its own text alone, so row order, ties and repeated rows
don't matter; other columns pass through unused.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ready
from . import arrays as A
from .common import long_ids

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper")
STATS_DDL = "doc_id long, " + ", ".join(f"{c} long" for c in STATS)
#: Rows that fit_rules learns from at most, those least in a hash of doc_id.
TRAIN_ROWS = 6000

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[0x30:0x3A] = True
UPPER = np.zeros(256, dtype=bool)
UPPER[0x41:0x5B] = True


def _first_seen(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (doc, code) pairs: index of each one's first place, its number, and how often each number occurs."""
    keys = A.mix(code ^ A.mix(doc.astype(A.U) + A.U(1)))
    _, first, number, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first, number, count


def chunk_stats(buf: np.ndarray, off: np.ndarray, window: int = 5) -> list[np.ndarray]:
    n = len(off) - 1
    starts, ends, doc = A.word_bounds(buf, off)
    n_words = A.per_doc(doc, n)
    # word_chars: bytes of words that don't continue a code point
    lead = np.zeros(len(buf) + 1, dtype=np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=lead[1:])
    word_chars = A.per_doc(doc, n, lead[ends] - lead[starts])

    def flagged(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(table[buf], out=sums[1:])
        return sums[off[1:]] - sums[off[:-1]]

    byte_sums = A.prefix(A.BYTE_CODE[buf])
    # lines: cut at every newline and at document bounds
    cut = np.flatnonzero(buf == 0x0A)
    line_start = np.unique(np.concatenate([off[:-1], cut + 1]))
    line_start = line_start[line_start < len(buf)]
    line_end = np.append(line_start[1:], len(buf))
    ends_nl = buf[line_end - 1] == 0x0A if len(line_end) else np.zeros(0, bool)
    line_end = line_end - ends_nl
    has_word = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_doc = np.searchsorted(off, line_start, "right") - 1
    n_lines = A.per_doc(line_doc, n)
    dup = n_lines.copy()
    if len(line_start):
        first, _, _ = _first_seen(line_doc, A.run_hash(byte_sums, line_start, line_end))
        dup -= A.per_doc(line_doc[first], n)
    # windows of words found twice or more in one text
    repeat = np.zeros(n, dtype=np.int64)
    if len(starts) >= window:
        sums = A.prefix(A.run_hash(byte_sums, starts, ends))
        at = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
        if len(at):
            _, number, count = _first_seen(doc[at], A.run_hash(sums, at, at + window))
            twice = at[count[number] > 1]
            repeat = A.per_doc(doc[A.covered(twice, window, len(doc))], n)
    return [n_words, word_chars, flagged(SYMBOL), dup, repeat, n_lines, flagged(DIGIT), flagged(UPPER)]


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            yield pa.RecordBatch.from_arrays([c.ids, *map(pa.array, chunk_stats(c.buf, c.off))], names=["doc_id", *STATS])

    return docs.select("doc_id", "text").transform(long_ids).transform(ready).mapInArrow(run, STATS_DDL)


#: What rules may test: name and expression over the statistics.
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "upper_per_char": "n_upper / greatest(word_chars, 1)",
}


class Test(NamedTuple):
    feature: str
    above: bool
    cut: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.cut if self.above else x[self.feature] <= self.cut

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


Rule = tuple[Test, ...]


def _hits(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for t in rule:
        out &= t.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most_tests: int, least: int) -> Rule:
    """Add the test of the largest information gain for low-quality rows until none helps."""
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most_tests:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p0 or not n0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            ends = np.flatnonzero(np.append(v[1:] != v[:-1], False))  # a cut lies between different values
            if not len(ends):
                continue
            p_low, all_low = np.cumsum(b)[ends], ends + 1
            cuts = (v[ends] + v[ends + 1]) / 2
            for above, p, total in ((False, p_low, all_low), (True, p0 - p_low, p0 + n0 - all_low)):
                gain = np.where(total >= least, p * (np.log2(np.maximum(p, 1e-9) / total) - base), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), Test(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def fit_rules(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, least: int = 8, precision: float = 0.6) -> list[Rule]:
    """Ordered rules for low quality. Rows come in a fixed order; every third one prunes."""
    left, rules = np.ones(len(bad), dtype=bool), []
    third = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and bad[left].any():
        grow, prune = left & ~third, left & third
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_tests, least)
        if not rule:
            break

        def worth(r: Rule, rows: np.ndarray) -> float:
            hit = _hits(r, {k: v[rows] for k, v in x.items()}, int(rows.sum()))
            p, n = int((hit & bad[rows]).sum()), int((hit & ~bad[rows]).sum())
            return (p - n) / (p + n) if p + n else -1.0

        best = max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r, prune), len(r)))
        hit = _hits(best, x, len(bad)) & left
        if hit.sum() < least or bad[hit].mean() < precision:
            break
        rules.append(best)
        left &= ~hit
    return rules


def rules_column(rules: list[Rule]) -> Column:
    """True where no rule for low quality holds: an ordered conditional expression."""
    out = None
    for rule in rules:
        both = rule[0].column()
        for t in rule[1:]:
            both = both & t.column()
        out = F.when(both, F.lit(False)) if out is None else out.when(both, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """Statistics and label of at most `most` labelled documents, those least in a hash of doc_id; of rows that repeat an id the least text."""
    some = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return text_stats(picked).join(F.broadcast(some), "doc_id")


def learn_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from a bounded sample of labelled rows; with no labels, none."""
    exprs = [F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()]
    got = training_rows(docs, labels).select("doc_id", "quality", *exprs).toPandas()
    if got.empty:
        return []
    got = got.assign(h=A.mix(got["doc_id"].to_numpy().astype(np.int64).view(A.U))).sort_values("h", kind="stable")
    return fit_rules({k: got[k].to_numpy() for k in FEATURES}, (got["quality"] == 0).to_numpy())


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed and kept for every document."""
    rules = learn_rules(docs, labels)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return text_stats(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules_column(rules))
