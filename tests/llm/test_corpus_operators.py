"""The operators on small tables with awkward rows, held against plain versions."""

import hashlib
import random
import tracemalloc
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lotespark.llm import arrays, bpe, components, decontaminate, langid, pfor, pii, quality, queries, rindex, simhash, substring_dedup, suffix_dedup, toxicity

BYTE_FILE, WORD_FILE = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ta", "é", "ru"]) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ".\n", ","]) for _ in range(n))


BASE = prose(1, 400)
ROWS = [
    (1, BASE), (2, BASE), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, prose(2, 60) + " " + BASE[300:1200] + " " + prose(3, 50)), (8, BASE.replace("ka", "xo", 1)), (9, "é" * 900),
    (10, " ".join(["same words here now"] * 60)), (11, prose(5, 3000)), (12, "mail a.b+c@x-y.example.com, ip 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111, call +49 (30) 1234-5678 now"),
    (13, "A#b * 1 <|endoftext|> don't 'S <|startoftext|>x"), (14, prose(6, 40) + "\n" + prose(6, 40)), (12, "a row that repeats an id"), (6, "one"),
]
UNIQUE = [r for k, r in enumerate(ROWS) if r[0] not in {q[0] for q in ROWS[:k]}]


def docs(spark, rows=ROWS, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n": F.lit(1), "h": F.lit("clash"), "score": F.lit("clash"), "fp": F.lit(2)})


def got(df, *cols):
    return sorted(map(tuple, (df.select(*cols) if cols else df).collect()), key=str)


def test_substring_dedup(spark):
    assert got(substring_dedup.substring_dedup(docs(spark)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(brute.op1(ROWS), key=str)
    assert substring_dedup.substring_dedup(docs(spark, [])).count() == 0


def test_suffix_dedup(spark):
    assert got(suffix_dedup.suffix_dedup(docs(spark)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op9(ROWS), key=str)
    assert suffix_dedup.suffix_dedup(docs(spark, [])).count() == 0


def test_common_parts_are_counted_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 1)
    rows = [(k, prose(10 + k, 30) + BASE[:1500] + prose(40 + k, 30)) for k in range(6)]
    assert got(suffix_dedup.suffix_dedup(docs(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op9(rows), key=str)


def test_run_index_is_brute_force():
    rng = random.Random(0)
    for _ in range(60):
        s = bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 50)))
        a = np.frombuffer(s, np.uint8)
        assert rindex.suffix_array(a).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        ms = rindex.matching_statistics(rindex.build(a))
        for i in range(len(s)):
            assert ms[i] == max([0, *(next((k for k in range(len(s) - max(i, j)) if s[i + k] != s[j + k]), len(s) - max(i, j)) for j in range(len(s)) if j != i)])


def test_bpe_is_the_tokenizer(spark):
    tok = Tokenizer.from_file(WORD_FILE)
    want = []
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(tok.decode(ids, skip_special_tokens=False))))
    assert got(bpe.digests(docs(spark), WORD_FILE)) == sorted(want, key=str)
    rng = random.Random(2)
    for _ in range(300):
        t = "".join(rng.choice("abs'tdrelvm 1\n.-é́Σ<|>½") for _ in range(rng.randint(0, 40)))
        ids = tok.encode(t, add_special_tokens=False).ids
        assert bpe.encode(WORD_FILE, t) == ids and bpe.decode(WORD_FILE, ids) == tok.decode(ids, skip_special_tokens=False)
    full = {r.doc_id: r for r in bpe.encoded(docs(spark, UNIQUE), WORD_FILE).collect()}
    assert all(full[i].ids == tok.encode(t or "", add_special_tokens=False).ids for i, t in UNIQUE)


def test_token_files_round_trip(spark):
    tok, at, want = Tokenizer.from_file(BYTE_FILE), 0, []
    for i, t in sorted(UNIQUE):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got(pfor.read_files(pfor.write_files(docs(spark, UNIQUE), BYTE_FILE))) == sorted(want, key=str)
    assert pfor.read_files(pfor.write_files(docs(spark, []), BYTE_FILE)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_blocks_round_trip(seed):
    rng = np.random.default_rng(seed)
    ids = [rng.integers(0, 50257, rng.integers(0, 900)), np.full(200, 9), np.append(np.arange(130), [2**32 - 1, 0]), (rng.pareto(1, 700) * 3).astype(np.int64) % 2**32][seed % 4]
    assert (pfor.unpack(pfor.pack(ids)) == ids).all()
    packed, size = pfor.pack(ids), pfor.BLOCK
    for k in range(-(-len(ids) // size)):
        assert (pfor.block(packed, k) == ids[k * size : (k + 1) * size]).all()
    with pytest.raises(IndexError):
        pfor.block(packed, -(-len(ids) // size))


def test_quality_statistics_and_rules(spark):
    stats = quality.text_stats(docs(spark)).withColumn("failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    assert got(stats, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed") == sorted(brute.op5(ROWS), key=str)
    rng = np.random.default_rng(0)
    x = {k: rng.random(3000) for k in quality.FEATURES}
    bad = (x["repeat_share"] > 0.8) | ((x["n_words"] < 0.2) & (x["mean_word"] > 0.5))
    rules = quality.fit_rules(x, bad ^ (rng.random(3000) < 0.02))
    hit = np.any([quality._hits(r, x, 3000) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.97
    column = spark.range(3).select(quality.rules_column([]).alias("k"))
    assert {r.k for r in column.collect()} == {True}
    assert quality.quality_rules(docs(spark), spark.createDataFrame([], "doc_id long, quality int")).count() == len(ROWS)


def test_pii_is_the_patterns(spark):
    rng = random.Random(7)
    odd = [(100 + k, "".join(rng.choice("12345@.+-() ax\n") for _ in range(rng.randint(0, 60)))) for k in range(400)]
    assert got(pii.find_pii(docs(spark, ROWS + odd)), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(brute.op7(ROWS + odd), key=str)
    a = pii.automaton()
    text = "see https://bob:pw1@host.example/x, IBAN DE89 3704 0044 0532 0130 00, account no: 123456789, token = \"4d44c79e8bf7c557\" é"
    assert [k for _, _, k in pii.find(a, text)] == ["login", "email", "iban", "account", "secret"] or {k for _, _, k in pii.find(a, text)} >= {"login", "iban", "account", "secret"}
    masked = {r.doc_id: r.text for r in pii.mask_pii(docs(spark, UNIQUE)).collect()}
    assert "[EMAIL]" in masked[12] and "a.b+c" not in masked[12] and masked[3] is None and masked[1] == BASE


def test_simhash(spark):
    rows = [(i, t) for i, t in UNIQUE] + [(200 + k, prose(300 + k % 4, 50) + (" end" if k % 2 else "")) for k in range(30)]
    want = [(i, f, c) for i, f, c in brute.op8(rows)]
    assert got(simhash.fingerprint_components(docs(spark, rows))) == sorted(want, key=str)
    assert simhash.fingerprint_components(docs(spark, [])).count() == 0


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(60)})
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "rep long, fp long")
    found = {r.node: r.component for r in components.components(simhash.fingerprint_links(nodes)).collect()}
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert all(found.get(i, i) == root(i) for i in range(len(fps)))


def test_golay_keys_tolerate_two_errors():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 1 << 23, 300)
    for errors in range(3):
        w = v.copy()
        for k in range(len(w)):
            for b in rng.choice(23, errors, replace=False):
                w[k] ^= 1 << int(b)
        assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(simhash.codewords(v), simhash.codewords(w), strict=True))


def test_near_duplicates(spark):
    rng = random.Random(5)
    rows = [(i, t) for i, t in UNIQUE]
    for g in range(12):
        words = prose(500 + g, 150).split()
        for c in range(5):
            edited = list(words)
            for _ in range(c * 2):
                edited[rng.randrange(len(edited))] = f"w{rng.random()}"
            rows.append((1000 + g * 10 + c, " ".join(edited)))
    want = brute.jaccard_groups(rows)
    assert got(simhash.near_duplicates(docs(spark, rows))) == sorted(want.items(), key=str)
    kept = simhash.keep_first(docs(spark, [*rows, (6, "one")]))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs(spark).columns


def test_repeated_ids_are_judged_by_their_texts(spark):
    """Different texts of one doc_id are rows of their own; equal rows are one."""
    a, b, c = prose(901, 80), prose(902, 80), prose(903, 80)
    df = docs(spark, [(1, a), (1, b), (1, b), (2, b + " end"), (3, a), (4, c), (None, c)])
    assert sorted(((r.doc_id, r.text) for r in simhash.keep_first(df).collect()), key=str) == sorted([(1, a), (1, b), (4, c), (None, c)], key=str)


def test_columns_of_the_caller_stay(spark):
    df = docs(spark, [(1, BASE), (2, "one"), (3, BASE)]).withColumns({"lang_pred": F.lit("mine"), "v": F.lit("clash"), "_v": F.lit(3)})
    assert simhash.keep_first(df).columns == df.columns and {r.v for r in simhash.keep_first(df).collect()} == {"clash"}
    assert {(r.score, r.lang_pred) for r in corpus_pipeline.language(spark, df, "").collect()} == {("clash", "mine")}
    with pytest.raises(ValueError, match="score"):
        langid.with_language(df, None)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.without_benchmark(df, items).columns == df.columns == pii.mask_pii(df).columns


def chained(seed, texts, n_words, step):
    """Texts that each differ from the one before in `step` words: neighbours are similar, the ends are not."""
    rng = random.Random(seed)
    words, out = prose(seed, n_words).split(), []
    for _ in range(texts):
        for _ in range(step):
            words[rng.randrange(len(words))] = f"w{rng.random()}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_in_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    licence = prose(77, 30)
    rows = list(enumerate([f"{licence} {t}" for g in range(3) for t in chained(700 + g, 120, 80, 1)], 1))
    random.Random(4).shuffle(rows)
    want = brute.jaccard_groups(rows)
    assert got(simhash.near_duplicates(docs(spark, rows))) == sorted(want.items(), key=str)


def test_linked_texts_of_large_buckets_find_further_ones(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 2)
    licence, rows = prose(78, 60), []
    for g in range(40):
        a, b, c = chained(800 + g, 3, 45, 2)
        rows += [(10 * g + 3, f"{licence} {a}"), (10 * g + 2, f"{licence} {b}"), (10 * g + 1, f"{licence} {c}")]
    want = brute.jaccard_groups(rows)
    assert got(simhash.near_duplicates(docs(spark, rows))) == sorted(want.items(), key=str)


def test_near_duplicates_of_few_words(spark):
    """One new word after a text of few different words moves most bits of a fingerprint, but one shingle of many."""
    rng, rows = random.Random(6), []
    for g in range(150):
        words = [f"v{g}x{k}" for k in range(4)]
        text = [rng.choice(words) for _ in range(60)]
        rows += [(2 * g, " ".join(text)), (2 * g + 1, " ".join([*text, f"new{g}"]))]
    want = brute.jaccard_groups(rows)
    assert got(simhash.near_duplicates(docs(spark, rows))) == sorted(want.items(), key=str)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(5, 5), (300, 301), (301, 302), (302, 303), (300, 303)]
    parent = {n: n for p in links for n in p}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    found = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(found.get(n, n) == root(n) for n in parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


ITEMS = [(0, prose(90, 40)), (1, prose(91, 30)), (2, None), (3, ""), (4, prose(90, 40))]


def test_decontamination(spark):
    rng = random.Random(8)
    item = ITEMS[0][1]
    edited = list(item)
    for _ in range(len(item) // 40):
        edited[rng.randrange(len(edited))] = "z"
    rows = [(1, prose(1, 200)), (2, prose(2, 50) + " " + item + " " + prose(3, 50)), (3, None), (4, ""), (5, ITEMS[1][1].upper().replace(" ", "  ")), (6, prose(4, 30) + " " + "".join(edited) + "!"), (7, item[: len(item) // 2])]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    hits = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(spark, rows), bench).collect()}
    assert set(hits) == {(2, 0), (2, 4), (5, 1), (6, 0), (6, 4)}
    assert rows[1][1][hits[2, 0].start : hits[2, 0].end] == item.rstrip(".,\n ") or abs(hits[2, 0].end - hits[2, 0].start - len(item)) <= 2
    kept = decontaminate.without_benchmark(docs(spark, rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 7] and kept.columns == docs(spark).columns
    assert decontaminate.find_benchmark(docs(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_decontamination_is_all_pairs(seed, monkeypatch):
    """Items of 1 to 60 letters with up to their budget of edits, in small steps and by correlation too, lose no match and make none up."""
    rng = random.Random(seed)
    alpha = ["abcdefghijkl mno", "ab", "abcdé,X "][seed % 3]
    items = [(k, "".join(rng.choice(alpha) for _ in range(rng.randint(1, 60)))) for k in range(8)]
    rows = []
    for d in range(5):
        parts = []
        for _ in range(3):
            parts.append("".join(rng.choice(alpha) for _ in range(rng.randint(0, 40))))
            t = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(t) // 10))):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randint(0, 1)] = rng.choice(["", alpha[0], alpha[1]])
            parts.append(" " * rng.randint(0, 1) + "".join(t) + " " * rng.randint(0, 1))
        rows.append((d, "".join(parts)))
    for name, value in (("HITS", 8), ("STRETCH", 32), ("DENSE", 0)) if seed % 2 else ():
        monkeypatch.setattr(decontaminate, name, value)
    index = decontaminate.items_index([k for k, _ in items], [t.encode() for _, t in items])
    texts = [t.encode() for _, t in rows]
    hits = decontaminate.chunk_hits(index, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    best = {}
    for d, it, _, _, e in hits.tolist():
        for k in index.ids[it].tolist():
            best[d, k] = min(best.get((d, k), 99), e)
    assert best == brute.op4(rows, items)


def test_repetitive_texts_need_little_memory():
    for item, text in (("ab" * 2000, "ab" * 200_000), ("a" * 3000, "a" * 300_000)):
        tracemalloc.start()
        index = decontaminate.items_index([1], [item.encode()])
        hits = decontaminate.chunk_hits(index, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        assert len(hits) and (hits[:, 4] == 0).all() and tracemalloc.get_traced_memory()[1] < 500 << 20
        tracemalloc.stop()


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    bench = spark.createDataFrame([(k, prose(90 + k, 20)) for k in range(6)] + [(7, "abcdefg"), (8, "?!")], "item_id long, text string")
    rows = [(k, prose(300 + k, 30) + " " + prose(90 + k, 20) + " " + prose(400 + k, 30)) for k in range(4)] + [(5, "xx abcdefg yy"), (6, "xxabcdefg"), (7, "abc")]
    hits = decontaminate.contaminated(docs(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in hits} == {(0, 0), (1, 1), (2, 2), (3, 3), (5, 7)}
    assert [(r.start, r.end) for r in hits if r.item_id == 7] == [(3, 10)]
    assert sorted(r.doc_id for r in decontaminate.without_benchmark(docs(spark, rows), bench).collect()) == [6, 7]


def test_alignment_is_edit_distance():
    rng = random.Random(2)

    def least(p, t):
        row = [0] * (len(t) + 1)
        for a in p:
            nxt = [row[0] + 1]
            for j, b in enumerate(t):
                nxt.append(min(row[j] + (a != b), row[j + 1] + 1, nxt[j] + 1))
            row = nxt
        return min(row)

    for _ in range(200):
        p = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
        t = [rng.randrange(3) for _ in range(rng.randint(1, 20))]
        width = len(p) + len(t) + 1
        got_ = decontaminate.banded([np.array(p, np.uint8)], np.array(t, np.uint8), np.array([0]), np.array([len(t)]), np.array([-len(p)]), np.array([width]), np.array([99]))
        assert got_[0, 0] == least(p, t)


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op3_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = out.where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in held)
    odd = langid.predict(docs(spark), None).collect()
    assert len(odd) == len(ROWS) and {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)}
    model = langid.learn(spark.read.parquet(f"{d}/documents.parquet"))
    got_ = {(r.doc_id, r.lang_pred == "und") for r in langid.predict(docs(spark, UNIQUE + [(50, "123 456 !!")]), model).collect()}
    assert {i for i, und in got_ if und} == {3, 4, 5, 50}


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    train, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.learn(train, labels.where("crc32(cast(doc_id as string)) % 4 <> 2"), most=1500)
    test = train.join(labels.where("crc32(cast(doc_id as string)) % 4 = 2"), "doc_id")
    rows = toxicity.score(test, model).join(labels, "doc_id").toPandas()
    bad, fine = rows[rows.toxic == 1].score.to_numpy(), rows[rows.toxic == 0].score.to_numpy()
    assert (bad[:, None] > fine[None]).mean() > 0.85
    odd = {r.doc_id: r.score for r in toxicity.score(docs(spark, UNIQUE), model).collect()}
    assert len(odd) == len(UNIQUE) and all(0 <= s <= 1 for s in odd.values()) and odd[3] == odd[4] == odd[5]
    assert {r.score for r in toxicity.score(docs(spark), None).collect()} == {0.0}


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: np.asarray(v, np.float64) for k, v in toxicity.start(rng).items()}
    slots, chars, idx, y = np.arange(5), rng.normal(size=(5, 8)), rng.integers(0, 6, (3, toxicity.TOKENS)), np.array([1.0, 0, 1])
    idx[:, 0] = 0
    g, _, _ = toxicity.gradients(p, slots, chars, idx, y)
    for name, at in (("win", (3, 5)), ("u0", (1, 2)), ("un1", (0, 3)), ("wa", (4, 1)), ("va", (2,)), ("wo", (7,)), ("word", (2, 1))):
        a, b = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        a[name][at] += 1e-4
        b[name][at] -= 1e-4
        slope = (toxicity.gradients(a, slots, chars, idx, y)[2] - toxicity.gradients(b, slots, chars, idx, y)[2]) / 2e-4
        assert abs(slope - g[name][at]) < 1e-4 * max(1, abs(slope)) + 2e-5


def test_windows_and_words():
    buf = np.frombuffer("ab  c\nd".encode(), np.uint8)
    s, e, d = arrays.word_bounds(buf, np.array([0, 1, 7]))
    assert list(zip(s.tolist(), e.tolist(), d.tolist(), strict=True)) == [(0, 1, 0), (1, 2, 1), (4, 5, 1), (6, 7, 1)]
    codes = arrays.mix(np.arange(50, dtype=np.uint64))
    assert arrays.minimizers(codes, 7).tolist() == [int(k + np.argmin(codes[k : k + 7] >> np.uint64(32))) for k in range(44)]
    assert hashlib.sha256(b"").hexdigest() == substring_dedup.EMPTY


def test_rows_without_ids_and_empty_tables(spark):
    """Operators that answer per row keep a row without an id; those that link rows by id leave it out."""
    df = docs(spark, [(None, BASE), (1, BASE), (2, prose(77, 80))])
    labels = spark.createDataFrame([(None, 1, 1), (1, 0, 1), (2, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = langid.learn(df)
    assert langid.predict(df, model).count() == bpe.digests(df, WORD_FILE).count() == pii.find_pii(df).count() == quality.quality_rules(df, labels).count() == 3
    assert toxicity.score(df, toxicity.learn(df, labels)).count() == 3
    for linked in (substring_dedup.substring_dedup(df), suffix_dedup.suffix_dedup(df), simhash.fingerprint_components(df)):
        assert sorted(r.doc_id for r in linked.select("doc_id").collect()) == [1, 2]
    assert [r.doc_id for r in pfor.read_files(pfor.write_files(df, BYTE_FILE)).orderBy("start").collect()] == [None, 1, 2]
    assert simhash.keep_first(df).count() == 3
    none = docs(spark, [])
    for empty in (langid.predict(none, langid.learn(none)), bpe.digests(none, WORD_FILE), pii.find_pii(none), quality.quality_rules(none, labels), toxicity.score(none, toxicity.learn(none, labels)), simhash.near_duplicates(none), decontaminate.find_benchmark(none, spark.createDataFrame(ITEMS, "item_id long, text string"))):
        assert empty.count() == 0


def test_token_files_of_repeated_and_missing_ids_have_one_order(spark):
    rows = [(7, prose(k, 20)) for k in range(30)] + [(None, prose(50, 9)), (None, None), (1, "one"), (9, "x"), (7, prose(3, 20))]
    tok = Tokenizer.from_file(BYTE_FILE)
    runs = []
    for parts in (1, 5):
        got = pfor.read_files(pfor.write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), BYTE_FILE)).orderBy("start").collect()
        runs.append([tuple(r) for r in got])
        at = 0
        for r in got:
            assert r.start == at
            at += r.n_tokens
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == [None] * 2 + [1] + [7] * 31 + [9]
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    assert sorted(r[3] for r in runs[0]) == sorted(crc(t) for _, t in rows)


def test_ids_that_are_no_numbers_are_refused_by_name(spark):
    df = spark.createDataFrame([("a", BASE)], "doc_id string, text string")
    for call in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, simhash.fingerprint_components, pii.find_pii, quality.text_stats, lambda d: bpe.digests(d, WORD_FILE), lambda d: pfor.write_files(d, BYTE_FILE)):
        with pytest.raises(TypeError, match="doc_id must be"):
            call(df)
    few = spark.createDataFrame([(1, BASE)], "doc_id int, text string")
    assert pii.find_pii(few).count() == quality.text_stats(few).count() == 1
