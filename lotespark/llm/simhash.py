"""SimHash near duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. A segment,
padded to 23 bits, has one to six codewords of the perfect Golay code within
distance 4; segments that differ in at most two bits share one of them. Two
fingerprints with at most two differing bits have a segment without error
(pigeonhole), so they share a key made of that segment and a codeword index of
the next one. Equal keys are joined and the distance verified.

Equal fingerprints are one node, so groups of copies never meet as rows. Keys
with more than BUCKET different fingerprints are dealt by exact midpoints
instead: fingerprints within distance two have a vector within one of both, and
no vector has more than 65 such neighbours.

`near_duplicates` finds documents whose sets of 5-word shingles have a Jaccard
similarity of 0.8 or more. Golay keys of fingerprints over those shingles give
the first candidates. But two such sets differ in about ten bits of 64 on
average, which no choice of segments brings within the keys' two; so an exact
prefix filter gives the others: with shingles in one order for all, rarest first,
two such texts share one of their first n - ceil(0.8 n) + 1, at positions that
leave enough others. Texts of a shingle that many share are first joined with one
of them; then only pairs that no chain of links joins are compared, if sizes,
positions and parity bits (a lower bound on the difference) allow the similarity.
The exact similarity verifies every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ready, release
from . import arrays as A
from .common import forget, fresh, long_ids, stored
from .components import components
from .toxicity import LOWER

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
BUCKET = 32
PAIRS_AT_ONCE = 1 << 17
SHINGLE_SIMILARITY = 0.8
#: Shingles are ordered by what one of so many documents shows, at most so many of the commonest last.
ORDER_PART, COMMON = 16, 1 << 16
#: Shingles for which 256 parity bits are enough; sets of more have twice as many bits, and so on.
BITS_FOR = 512


@lru_cache(maxsize=1)
def golay() -> np.ndarray:
    """For each syndrome the differences [2048, 6] of codeword indices within distance 4; -1 where there are fewer."""

    def remainder(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - 11)), v)
        return v

    info = np.arange(1 << 12, dtype=np.int64) << 11
    words = info | remainder(info)
    seven = words[np.bitwise_count(words) == 7].tolist()
    out = np.full((1 << 11, 6), -1, dtype=np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            near = [error] + [error ^ w for w in seven if weight == 3 and w & error == error]
            s = int(remainder(np.array([error]))[0])
            out[s, : len(near)] = [e >> 11 for e in near]
    return out


@lru_cache(maxsize=1)
def syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; a vector's is their difference."""
    v = np.concatenate([np.arange(1 << 12, dtype=np.int64), np.arange(1 << 11, dtype=np.int64) << 12])
    for bit in range(22, 10, -1):
        v = np.where(v >> bit & 1, v ^ (GENERATOR << (bit - 11)), v)
    return v[: 1 << 12], v[1 << 12 :]


def codewords(v: np.ndarray) -> np.ndarray:
    """Indices [n, 6] of the codewords within distance 4 of each 23-bit vector; -1 where there are fewer."""
    low, high = syndromes()
    near = golay()[low[v & 0xFFF] ^ high[v >> 12]]
    return np.where(near >= 0, (v >> 11)[:, None] ^ near, -1)


def segments(fp: np.ndarray) -> list[np.ndarray]:
    return [((fp >> A.U(at)) & A.U((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]


def link_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints: an exact segment with a codeword index of the next one. Returns row and key."""
    parts, rows, keys = segments(fp), [], []
    for i in range(3):
        near = codewords(parts[(i + 1) % 3])
        row, col = np.nonzero(near >= 0)
        rows.append(row)
        keys.append((np.int64(i) << 40) | (parts[i][row] << 12) | near[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def shingled(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[memoryview, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by one space, and start, end and document of each shingle in them.

    A text with fewer words than the width has one shingle of them all; one without words has none.
    """
    low = LOWER[buf]
    starts, ends, doc = A.word_bounds(low, off)
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    flat = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
    flat[A.ranges(at, size)] = low[A.ranges(starts, size)]
    n = len(off) - 1
    first = A.word_offsets(doc, n)
    count = first[1:] - first[:-1]
    short = np.flatnonzero((count > 0) & (count < width))
    begin = np.flatnonzero(doc[: len(doc) - width + 1] == doc[width - 1 :]) if len(doc) >= width else np.zeros(0, np.int64)
    begin, close = np.concatenate([begin, first[short]]), np.concatenate([begin + width - 1, first[short + 1] - 1])
    order = np.argsort(begin, kind="stable")
    begin, close = begin[order], close[order]
    return memoryview(flat), at[begin], at[close] + size[close], doc[begin]


def majority(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints: a bit is set if it is in over half of the document's hashes."""
    out = np.zeros(n, dtype=A.U)
    if not len(h):
        return out
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ones = np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    total = np.diff(np.append(first, len(doc)))
    out[doc[first]] = np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def chunk_fingerprints(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    text, start, end, doc = shingled(buf, off, 3)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], 42) for a, b in zip(start.tolist(), end.tolist(), strict=True)), A.U, len(start))
    return majority(h, doc, len(off) - 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (as a signed long) of every document; no words: 0. Rows without a doc_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(chunk_fingerprints(c.buf, c.off).view(np.int64))], names=["doc_id", "fp"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").transform(long_ids).transform(ready).mapInArrow(run, "doc_id long, fp long")


def _bucket_keys(nodes: DataFrame) -> DataFrame:
    """key, rep and fp: a row for each key of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column("fp").to_numpy(zero_copy_only=False), batch.column("rep")
            row, key = link_keys(fp.view(A.U))
            yield pa.RecordBatch.from_arrays([pa.array(key), rep.take(pa.array(row)), pa.array(fp[row])], names=["key", "rep", "fp"])

    return nodes.select("rep", "fp").transform(ready).mapInArrow(run, "key long, rep long, fp long")


def _close_pairs(buckets: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b), a > b, of the members [(rep, fp)] of each bounded bucket that differ in at most `bits` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            size = np.diff(members.offsets.to_numpy())
            flat = members.flatten()
            rep, fp = flat.field("rep").to_numpy(zero_copy_only=False), flat.field("fp").to_numpy(zero_copy_only=False).view(A.U)
            at = np.cumsum(size) - size
            for n in np.unique(size[size > 1]).tolist():  # buckets of one size together, PAIRS_AT_ONCE pairs at a time
                i, j = np.triu_indices(n, 1)
                base, step = at[size == n], max(1, PAIRS_AT_ONCE // len(i))
                for k in range(0, len(base), step):
                    b = base[k : k + step, None]
                    x, y = (b + i).ravel(), (b + j).ravel()
                    near = np.bitwise_count(fp[x] ^ fp[y]) <= bits
                    x, y = rep[x[near]], rep[y[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return buckets.select("members").transform(ready).mapInArrow(run, "a long, b long").where("a > b").distinct()


def fingerprint_links(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """Links (a, b) that join all fingerprints at most two bits apart. nodes: rep and fp, one row for each fp."""
    keys = _bucket_keys(nodes)
    sizes = stored(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    small = keys.join(sizes.where(F.col("n") <= BUCKET), "key").groupBy("key").agg(F.collect_list(F.struct("rep", "fp")).alias("members"))
    large = keys.join(sizes.where(F.col("n") > BUCKET), "key").select("rep", "fp").distinct()
    middle = F.concat(F.array("fp"), F.expr("transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k))"))
    around = large.select("rep", F.explode(middle).alias("w")).groupBy("w").agg(F.collect_list("rep").alias("reps")).where(F.size("reps") > 1)
    stars = around.select(F.explode("reps").alias("a"), F.array_min("reps").alias("b")).where("a > b").distinct()
    return _close_pairs(small, bits).union(stars)


def fingerprint_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    fps = stored(fingerprints(docs), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = components(fingerprint_links(nodes)).withColumnRenamed("node", "rep")
    named = nodes.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


# Near duplicates by 5-word shingles


def _words(c: A.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and document of each lower-cased word, and where each document's words begin."""
    low = LOWER[c.buf]
    starts, ends, doc = A.word_bounds(low, c.off)
    return A.bytes_hash(low, starts, ends), doc, A.word_offsets(doc, len(c.off) - 1)


def _shingles(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different 5-word shingles of each document, as hashes in ascending order, and their documents."""
    at = np.flatnonzero(doc[: max(len(doc) - 4, 0)] == doc[4:])
    h, owner = A.run_hash(A.prefix(word), at, at + 5), doc[at]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    return h[new], owner[new]


def _common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending; ranks from 1) of the commonest shingles in a part of the documents.

    They only order the shingles: any order gives the same candidates of similarity `least`, a better one gives fewer others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            word, doc, _ = _words(c)
            yield pa.RecordBatch.from_arrays([pa.array(_shingles(word, doc)[0].view(np.int64))], names=["h"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_PART)) == 0).select("doc_id", "text").transform(ready).mapInArrow(run, "h long")
    top = part.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMON).collect()
    h = np.array([r.h for r in top], dtype=np.int64).view(A.U)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order]


def _parity(h: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of all sets' parity bits, size[k] bits (256 or twice as often doubled) for set k: is an odd number of its elements on a bit?

    Two sets differ in at least as many elements as their bits do; of two sizes the larger folds onto the smaller.
    """
    base = np.cumsum(size) - size
    spot = base[owner] + ((h >> A.U(32)).astype(np.int64) & (size[owner] - 1))
    spot, times = np.unique(spot, return_counts=True)
    spot = spot[times % 2 == 1]
    out = np.zeros(int(size.sum()) // 8, dtype=np.uint8)
    np.bitwise_or.at(out, spot >> 3, (1 << (spot & 7)).astype(np.uint8))
    return out


SIGNATURE_DDL = "doc_id long, v long, h1 long, h2 long, n int, fp long, b0 long, b1 long, b2 long, b3 long, parity binary, prefix array<long>"


def _signatures(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, v, hashes of the word sequence, and number, fingerprint, parity bits and prefix of its shingles.

    The prefix are the first n - ceil(least n) + 1 of n different shingles, rarest first: two sets at that similarity share one.
    """
    common, rank = _common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            n = len(c.off) - 1
            word, doc, first = _words(c)
            whole = A.run_hash(A.prefix(word), first[:-1], first[1:])
            second = A.run_hash(A.prefix(A.mix(word ^ A.U(0x5851F42D4C957F2D))), first[:-1], first[1:])
            h, owner = _shingles(word, doc)
            count = np.bincount(owner, minlength=n)
            fp, bits = majority(h, owner, n), _parity(h, owner, np.full(n, 256)).view("<i8").reshape(n, 4)
            size = 256 << np.ceil(np.log2(np.maximum(count / BITS_FOR, 1))).astype(np.int64)
            parity = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(0, np.cumsum(size // 8)).astype(np.int32)), pa.py_buffer(_parity(h, owner, size))])
            if len(common):
                at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                order = np.lexsort((h, np.where(common[at] == h, rank[at], 0), owner))
                h = h[order]
            begin = np.cumsum(count) - count
            size = np.where(count > 0, count - np.ceil(least * count - 1e-9).astype(np.int64) + 1, 0)
            taken = A.ranges(begin, size)
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(h[taken].view(np.int64)))
            longs = [pa.array(x) for x in (whole.view(np.int64), second.view(np.int64), count.astype(np.int32), fp.view(np.int64), *(np.ascontiguousarray(b) for b in bits.T))]
            yield pa.RecordBatch.from_arrays([c.ids, c.rows.column("v"), *longs, parity, prefix], names=["doc_id", "v", "h1", "h2", "n", "fp", "b0", "b1", "b2", "b3", "parity", "prefix"])

    return docs.select("doc_id", "v", "text").transform(long_ids).transform(ready).mapInArrow(run, SIGNATURE_DDL)


def _fingerprint_pairs(one: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of texts whose fingerprints are equal or, by Golay keys, at most two bits apart: joined by stars, not all pairs."""
    alike = one.where("n > 0").groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("m"))
    alike = stored(alike, "fingerprints")
    equal = one.where("n > 0").join(alike.where("m > 1").select(F.col("fp").bitwiseXOR(F.lit(0)).alias("fp"), "rep"), "fp").select(F.col("node").alias("a"), F.col("rep").alias("b")).where("a > b")
    return equal.union(fingerprint_links(alike.select("rep", "fp")))


def _shared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of keys that two to BUCKET texts share, as lists; rows of keys that more share, with that number m). rows: key, pos, rep, n."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    both = stored(rows.join(sizes.select(F.col("key").bitwiseXOR(F.lit(0)).alias("key"), "m"), "key"), "prefixes")
    small = both.where(F.col("m") <= BUCKET).groupBy("key").agg(F.collect_list(F.struct("rep", "n", "pos")).alias("members"))
    return small, both.where(F.col("m") > BUCKET)


def _likely_pairs(buckets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a > b, of the members [(rep, n, pos)] of each bounded bucket whose sizes and positions allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            size = np.diff(members.offsets.to_numpy())
            rep, n, pos = (members.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("rep", "n", "pos"))
            at = np.cumsum(size) - size
            for m in np.unique(size[size > 1]).tolist():  # buckets of one size together, PAIRS_AT_ONCE pairs at a time
                i, j = np.triu_indices(m, 1)
                base, step = at[size == m], max(1, PAIRS_AT_ONCE // len(i))
                for k in range(0, len(base), step):
                    b = base[k : k + step, None]
                    x, y = (b + i).ravel(), (b + j).ravel()
                    rest, most = np.minimum(n[x] - pos[x], n[y] - pos[y]), np.maximum(n[x], n[y])
                    fit = (np.minimum(n[x], n[y]) >= least * most - 1e-6) & (rest >= least / (1 + least) * (n[x] + n[y]) - 1e-6)
                    x, y = rep[x[fit]], rep[y[fit]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

    return buckets.select("members").transform(ready).mapInArrow(run, "a long, b long").where("a > b").distinct()


def _star_pairs(hot: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a > b: each text of common shingles with one other text of up to three of them, the one least changed from what they share."""
    key_hash = F.xxhash64("key")
    own = hot.groupBy("rep").agg(F.first("n").alias("n"), F.array(F.max_by("key", F.struct("m", "key")), F.min_by("key", key_hash), F.max_by("key", key_hash)).alias("keys"))
    own = own.select("rep", "n", F.explode(F.array_distinct("keys")).alias("key"))
    # the text with fewest rarer shingles before this one
    middle = hot.groupBy("key").agg(F.min_by(F.struct("rep", "n"), F.struct("pos", F.xxhash64("rep"))).alias("y")).select(F.col("key").bitwiseXOR(F.lit(0)).alias("key"), "y")
    sizes = F.least("n", "y.n") >= F.greatest("n", "y.n") * least - 1e-6
    return own.join(middle, "key").where(sizes).select(F.greatest("rep", "y.rep").alias("a"), F.least("rep", "y.rep").alias("b")).where("a > b")


def _likely(least: float) -> Column:
    """May rows x and y of one key have the similarity, by their sizes, the key's positions and their parity bits, if no earlier shingle is in both?"""
    most = F.expr("x.n + y.n")
    sizes = F.expr("least(x.n, y.n)") >= F.expr("greatest(x.n, y.n)") * least - 1e-6
    places = F.expr("least(x.n - x.pos, y.n - y.pos)") >= most * (least / (1 + least)) - 1e-6
    bits = F.expr(" + ".join(f"bit_count(x.b{k} ^ y.b{k})" for k in range(4))) <= most * ((1 - least) / (1 + least)) + 1e-6
    return sizes & places & bits


def _open_pairs(hot: DataFrame, found: DataFrame, one: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a > b, of texts that share a common shingle, that no chain of links joins, and that may be similar.

    Of each shingle every text outside its largest component is compared with all texts of other components.
    """
    named = hot.select("key", "rep", "n", "pos").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    named = stored(named, "hot")
    labels = named.groupBy("key", "label").agg(F.count("*").alias("m"))
    mixed = labels.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.count("*").alias("k")).where("k > 1")
    open_ = named.join(mixed.select(F.col("key").bitwiseXOR(F.lit(0)).alias("key"), "main"), "key")
    bits = one.select(F.col("node").alias("rep"), "b0", "b1", "b2", "b3")
    open_ = stored(open_.join(bits, "rep"), "open")
    forget(named)
    some = open_.where("label <> main").withColumn("key", F.col("key").bitwiseXOR(F.lit(0)))
    met = open_.alias("x").join(some.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.label") != F.col("y.label")) & _likely(least))
    out = stored(met.select(F.expr("greatest(x.rep, y.rep)").alias("a"), F.expr("least(x.rep, y.rep)").alias("b")).distinct(), "open-pairs")
    forget(open_)
    return out


def _set_rows(texts: DataFrame) -> DataFrame:
    """id and its sorted different 5-word shingle hashes as bytes. texts: doc_id (the id), text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in A.chunks(batches):
            n = len(c.off) - 1
            h, owner = _shingles(*_words(c)[:2])
            bounds = np.searchsorted(owner, np.arange(n + 1))
            sets = [h[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([c.ids, pa.array(sets, pa.binary())], names=["id", "shingles"])

    return texts.select("doc_id", "text").transform(ready).mapInArrow(run, "id long, shingles binary")


def _alike(pairs: DataFrame, one: DataFrame, least: float) -> DataFrame:
    """The pairs whose sizes and parity bits allow the similarity."""
    side = lambda k: one.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-6)
    share = (1 - least) / (1 + least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (share * (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) + 1e-6).tolist()
            keep = []
            for x, y, m in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), most, strict=True):
                if len(x) < len(y):
                    x, y = y, x
                bits, size = int.from_bytes(x, "little"), 8 * len(x)
                while size > 8 * len(y):
                    size //= 2
                    bits = (bits >> size) ^ (bits & ((1 << size) - 1))
                keep.append((bits ^ int.from_bytes(y, "little")).bit_count() <= m)
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=["a", "b"])

    return stored(rows.select("a", "b", "na", "nb", "pa", "pb").transform(ready).mapInArrow(run, "a long, b long"), "alike")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs of nodes whose shingle sets have a Jaccard similarity of at least `least`. docs: doc_id, v, text."""
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes, "node").select("node", "one.doc_id", "one.v")
    # a join of texts that shuffles whatever the other side's size, so that plans don't change with the input; repeated rows give one
    texts = docs.join(ids.hint("shuffle_hash"), ["doc_id", "v"]).groupBy("doc_id", "v").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    sets = stored(_set_rows(texts.select(F.col("node").alias("doc_id"), "text")), "shingle-sets")
    release(docs.sparkSession)
    rows = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(both > 0 and both >= least * (len(x) + len(y) - both))
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=["a", "b"])
        A.give_back()

    out = stored(rows.select("a", "b", "x", "y").transform(ready).mapInArrow(run, "a long, b long"), "verified")
    forget(sets)
    return out


def _near_groups(docs: DataFrame, least: float) -> DataFrame:
    """doc_id, v (a hash of the text) and `first`, the least (doc_id, v) of its group, for every row of docs: doc_id, v, text."""
    sigs = stored(_signatures(docs, least), "signatures")
    # a node for each word sequence, numbered once and written, so that the numbers stay
    nodes = stored(sigs.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "v")).alias("one")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    one = sigs.join(nodes.select("h1", "h2", "one.doc_id", "one.v", "node"), ["h1", "h2", "doc_id", "v"]).where("n > 0").drop("h1", "h2")
    one = stored(one, "texts")  # repeated rows may come twice, which changes no result
    small, hot = _shared(one.select(F.col("node").alias("rep"), "n", F.posexplode("prefix").alias("pos", "key")).select("key", "pos", "rep", "n"))
    release(docs.sparkSession)
    one = one.drop("prefix", "doc_id", "v")
    pairs = stored(_likely_pairs(small, least).union(_star_pairs(hot, least)).union(_fingerprint_pairs(one)).distinct(), "pairs")
    release(docs.sparkSession)
    alike = _alike(pairs, one, least)
    links = _verified(alike, docs, nodes, least)
    release(docs.sparkSession)
    found = components(links)
    further = _open_pairs(hot, found, one, least).join(pairs, ["a", "b"], "left_anti")
    more = _alike(further, one, least)
    for table in (small, one, pairs, alike):
        forget(table)
    if not more.isEmpty():
        found = components(links.union(_verified(more, docs, nodes, least)))
    release(docs.sparkSession)
    named = stored(nodes.join(found, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "labels")
    first = named.groupBy("label").agg(F.min("one").alias("first")).withColumn("label", F.col("label").bitwiseXOR(F.lit(0)))
    firsts = named.join(first, "label").select("h1", "h2", "first")
    out = stored(sigs.select("doc_id", "v", "h1", "h2").join(firsts, ["h1", "h2"]).select("doc_id", "v", "first"), "groups")
    for table in (sigs, nodes, links, more, named, found):
        forget(table)
    return out


def _keyed(docs: DataFrame, v: str = "v") -> DataFrame:
    """Rows with a doc_id, and a hash of the text beside it: repeated ids stay apart."""
    return docs.where("doc_id IS NOT NULL").withColumn(v, F.xxhash64(F.coalesce("text", F.lit(""))))


def near_duplicates(docs: DataFrame, least: float = SHINGLE_SIMILARITY) -> DataFrame:
    """doc_id and component_id (least doc_id of the group) of every row with a doc_id.

    Texts with the same word sequence are one node; texts without words are one
    group. Different texts that repeat a doc_id are judged each by its own text.
    """
    return _near_groups(_keyed(docs.select("doc_id", "text")), least).select("doc_id", F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, least: float = SHINGLE_SIMILARITY) -> DataFrame:
    """The documents, all columns, without those that an earlier one of their group, by doc_id and then by a hash of the text, stands for.

    Of equal rows (doc_id and text) one stays; rows without a doc_id all stay.
    """
    v = fresh(docs, "v")
    rows = docs.withColumn(v, F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = _near_groups(_keyed(docs.select("doc_id", "text")), least).select("doc_id", F.col("v").alias(v), "first")
    twice = groups.where(F.struct("doc_id", v) == F.struct("first.doc_id", "first.v")).groupBy("doc_id", v).count().where("count > 1").select("doc_id", v)
    gone = groups.where(F.struct("doc_id", v) != F.struct("first.doc_id", "first.v")).select("doc_id", v).distinct()
    if twice.isEmpty():
        return rows.join(gone.hint("shuffle_hash"), ["doc_id", v], "left_anti").select(docs.columns)
    once = rows.join(twice, ["doc_id", v], "left_semi").dropDuplicates(["doc_id", v])
    return rows.join(gone.union(twice), ["doc_id", v], "left_anti").select(docs.columns).union(once.select(docs.columns))
