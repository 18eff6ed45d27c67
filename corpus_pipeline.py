"""The corpus pipeline: language, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes the documents its predecessor kept and returns the kept ones with the columns of documents; the last
returns each document's token ids. ``run`` writes every stage's result to the shared folder and reads it again, so a
lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.llm import bpe, langid, simhash, suffix, winnow
from tonegauge.llm.common import crc_bucket
from tonegauge.session import settle

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter go, and those whose nearest codewords tie. Where no document has a
    language to learn from, none is recognised and all go."""
    found = langid.identify(docs, crc_bucket(F.col("doc_id"), 3) != 1, COLUMNS)
    return found.where((F.col("lang_pred") != "und") & ~F.col("tied")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that stand earlier; letters cut in two go as a whole. Texts with nothing left stay, empty."""
    kept = suffix.dedup(docs, texts=True, keep=["lang", "source"])
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length(F.coalesce("kept_text", F.lit(""))).cast("bigint").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items contaminate go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = winnow.find_items(docs, items, keep=["text", "lang", "source", "n_chars"])
    return found.where(~winnow.contaminated()).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count, digests and ids of every document; a NULL or empty text has no ids."""
    return bpe.encode_texts(docs, F.col("text"), public_tokenizers.path("word_bpe_49k.json"), {"doc_id": "bigint"}, with_ids=True, with_decoded=False)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("bpe", tokens),
]
#: No SQL states the learned language model, the simhash groups or the merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
