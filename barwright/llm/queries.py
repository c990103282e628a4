"""Queries of the training-data operators over the driver tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from barwright.llm import automaton, bpe, caps, chat, codes, jaccard, langid, lexical, licenses, packing, pii, shards, winnow
from barwright.llm.common import ship, table
from barwright.llm.sql import SQL
from barwright.session import prepare

PACKING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors: links, components and what stays."""
    return caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of equal row counts that keep linked documents together."""
    return shards.assign(table(spark, sf_dir, "documents"))


def op3_bayesian_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents on five-word shingles: class, links, component, what stays."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "component_id", "kept")


def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat examples per assistant turn, read back from their formatted strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.expand(rows.unionByName(more)))


def op5_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template matches per document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    docs = table(spark, sf_dir, "documents")
    pieces = packing.pack(packing.tokenise(docs, PACKING_TOKENIZER), packing.group_count(docs))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by a network trained on documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op8_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes they decode to, as digests."""
    ids = bpe.encode(table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    both = bpe.decode(ids, BYTE_RANKS, public_tokenizers.PATTERN)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and how alike they are."""
    found = winnow.fingerprint_edits(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op10_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their personal data replaced, and how many entities each had."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, count="n_entities")


def op11_merge_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by the tokenization automaton and the text they decode to, as digests."""
    ids = automaton.encode(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, public_tokenizers.PATTERN)
    both = automaton.decode(ids, BYTE_TOKENIZER)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_blocked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, and the digest of the codebooks."""
    coded, book = codes.compress(table(spark, sf_dir, "embeddings"))
    found = codes.with_label_errors(coded)
    return found.select("vec_id", "code", "error", "label_error", F.lit(codes.book_digest(book)).alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, near-duplicates, surrogates, packing, one after the other."""
    return corpus_pipeline.run(spark, sf_dir)


NAMED = (op1_cap_filters, op2_label_propagation, op3_bayesian_jaccard, op4_prefix_targets, op5_license_blocks, op6_tournament_packing, op7_byte_network,
         op8_segment_tree_bpe, op9_winnowing, op10_surrogates, op11_merge_automaton, op12_blocked_products, op13_resident_lloyd, pipeline)


def queries() -> dict:
    def prepared(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return function(prepare(spark), sf_dir)
        run.__doc__ = function.__doc__
        return run
    return {function.__name__: prepared(function) for function in NAMED}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
