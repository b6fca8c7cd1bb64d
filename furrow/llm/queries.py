"""One query per operator, applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, language, line_quality, mixing, prefix_trie, sharding, simhash, suffix_dedup, token_store, topk, url_reputation, variants, warc
from .common import table

# Fixed values of the contract: verdict, host, path.
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written with the range coder and read back."""
    return token_store.stored_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows of the bit-sliced index for every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles."""
    return language.predicted_languages(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 100 bytes."""
    return suffix_dedup.deduplicated_digests(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoding, as digests."""
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix of all sources takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules with cross-document line frequency per source."""
    return line_quality.judge_quality(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back through the capture index."""
    return warc.archived_and_read(spark, table(spark, sf_dir, "pages"))


def op10_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls judged by rules, then by reputation; labelled pages are those whose id has a label."""
    labels = table(spark, sf_dir, "labels")
    good = F.when((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), 1).otherwise(0)
    outcomes = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("page_id"), good.alias("good"))
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the frequent word they are a variant of."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_topk": op2_topk,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_bpe": op6_bpe,
    "op7_mixing": op7_mixing,
    "op8_line_quality": op8_line_quality,
    "op9_warc": op9_warc,
    "op10_url_reputation": op10_url_reputation,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sharding": op12_sharding,
    "op13_variants": op13_variants,
}
