"""The corpus pipeline: stages over `documents`, each written and read again.

Language ID drops texts in no language; SimHash near-dedup keeps one document of
each group; decontamination drops documents that hold a benchmark item; PII is
masked in place; BPE turns what is left into token ids. A stage sees all rows
its predecessor kept, and every stage but the last returns the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotespark.llm import bpe, decontaminate, langid, pii, simhash
from lotespark.llm.common import forget, fresh, stored, table
from lotespark.llm.queries import tokenizer_file

#: Below this mean probability no language is named; with four languages chance gives a quarter.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without letters, or that fit none of those learnt, go."""
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = langid.with_language(docs, langid.learn(docs), lang, score)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each near-duplicate group."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked by its kind; n_chars follows the text."""
    out = pii.mask_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of the text they decode to."""
    return bpe.encoded(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("decontamination", decontamination), ("pii", mask), ("bpe", tokens)]

ORACLE_SQL = None  # models, fuzzy matching and tokenization are beyond SQL; tests hold each stage against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        forget(last)
        last = docs
    return docs
