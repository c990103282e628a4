"""A corpus pipeline over documents: language, near-duplicates, surrogates for personal data, packed sequences."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barwright.llm import jaccard, langid, packing, pii
from barwright.llm.common import fresh
from barwright.session import ensure_checkpoint_dir

# Texts of known language score far above this; a text that no language explains goes.
LEAST_SCORE = 0.3
# Words and parts that a Python worker of the packing stage remembers: executors keep the workers of all stages.
REMEMBERED = 100_000
# Rows and result have no SQL: a trained network and a tokenizer take part.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a recognised language; a missing `lang` is filled in. Null texts and texts without letters go."""
    network = langid.fit(docs)
    lang, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = langid.identify(docs, network, keep=tuple(docs.columns), lang=lang, score=score)
    kept = found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", lang)).select(*[F.col(f"`{name}`") for name in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of least doc_id."""
    return jaccard.distinct_documents(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their place in a sequence."""
    tokens = packing.tokenise(docs, public_tokenizers.path("word_bpe_49k.json"), words=REMEMBERED, parts=REMEMBERED)
    return packing.pack(tokens, packing.group_count(docs)).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", languages), ("near_copies", near_copies), ("private_data", private_data), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on `documents`, each written as Parquet in the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
