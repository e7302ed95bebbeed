"""Thin queries over the operators, one per operator, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, filter_audit, langid, pfor, pii, quality, simhash, substring_dedup, suffix_dedup, toxicity, url_filter
from .common import crc_part, stored, table


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies on this machine; the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, usable=crc_part("doc_id", 3) != 1)
    out = langid.predict(docs, model)
    return out.select("doc_id", (crc_part("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfor.read_files(pfor.write_files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), usable=crc_part("doc_id", 4) != 2)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (crc_part("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(*centroids.sort_means(table(spark, sf_dir, "embeddings")))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url and good: these tables' urls end in the doc_id of the text that the page was made from, whose labels are the page's; good is quality 1 and not toxic."""
    _, path = url_filter.host_and_path("url")
    doc = F.regexp_extract(path, r"/([0-9]+)(\.html)?/?$", 1).try_cast("bigint")
    bad = F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
    known = stored(labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg((~bad).alias("good")), "page-labels")
    return pages.select("page_id", "url", doc.alias("doc")).join(known, "doc", "left").select("page_id", "url", "good")


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return url_filter.judged(pages, "good").select("page_id", "host", "path", "rule", "verdict", "template", "purity")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_files": op6_token_files,
    "op7_pii": op7_pii,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_centroids": op12_centroids,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {"op11_filter_audit": filter_audit.SQL, "op12_centroids": centroids.SQL}
