"""The corpus pipeline on the smallest tables: each stage against what it must keep."""

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lotespark.llm import bpe, decontaminate, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(900001, None), (900002, "12 34 !!"), (900003, "mail x@y.example.com please, the end of it and of all that")], "doc_id long, text string")
    docs = docs.unionByName(extra.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1).cast("bigint")}), allowMissingColumns=True)
    out = [("documents", docs.cache())]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stage(spark, out[-1][1], SF).cache()))
    return dict(out)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and all(steps[n].columns == steps["documents"].columns for n in names[:-1])


def test_language_drops_only_texts_without_language(steps):
    assert set(ids(steps["documents"])) - set(ids(steps["language_id"])) >= {900001, 900002}
    lost = steps["documents"].join(steps["language_id"].select("doc_id"), "doc_id", "left_anti").where("length(text) > 40 AND text rlike '[a-zA-Z]{3}'")
    assert lost.count() == 0


def test_near_dedup_keeps_one_of_each_group(steps):
    rows = [(r.doc_id, r.text) for r in steps["language_id"].select("doc_id", "text").collect()]
    assert ids(steps["simhash_near_dedup"]) == sorted(set(brute.jaccard_groups(rows).values()))


def test_decontamination_drops_holders(steps, spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in steps["simhash_near_dedup"].collect()}
    holders = {i for i, t in before.items() if any(b in t for b in items)}
    gone = set(before) - set(ids(steps["decontamination"]))
    hits = {r.doc_id for r in decontaminate.contaminated(steps["simhash_near_dedup"], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert holders <= gone == hits


def test_pii_masks_and_keeps(steps):
    assert ids(steps["pii"]) == ids(steps["decontamination"])
    after = {r.doc_id: r for r in steps["pii"].collect()}
    assert "[EMAIL]" in after[900003].text and after[900003].n_chars == len(after[900003].text)
    assert all(n[1:5] == (0, 0, 0, 0) for n in brute.op7([(i, r.text) for i, r in after.items()]) if "[" not in after[n[0]].text)


def test_tokens(steps):
    path = queries.tokenizer_file("word_bpe_49k.json")
    texts = {r.doc_id: r.text for r in steps["pii"].collect()}
    rows = steps["bpe"].collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.ids == bpe.encode(path, texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows[:20])
