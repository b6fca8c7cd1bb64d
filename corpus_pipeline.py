"""A training corpus from raw documents: language, near-duplicates, repeated strings, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from furrow.llm import bpe, language, mixing, simhash, suffix_dedup
from furrow.llm.common import table, ready, written


# Prose of a learned language scores over 0.4; a text of another alphabet has no n-gram of any profile and scores 0.
LEAST_SCORE = 0.1


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, sure enough; ``lang`` is the prediction where it was null.

    Null texts, texts without a letter and texts that score under ``LEAST_SCORE`` go. If no language could be
    learned, all texts with a letter stay as they are.
    """
    ready(spark)
    profiles = language.learn_profiles(docs.select("doc_id", "text", "lang"))
    names = docs.columns
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"))
    value = lambda c: F.col("text") if c == "text" else F.col("row")[c].alias(c)
    if not profiles:
        return language.with_letters(rows).select(*map(value, names))
    kept = language.identify(rows, profiles).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    lang = F.coalesce(F.col("row")["lang"], F.col("lang_pred")).alias("lang")
    return kept.select(*[lang if c == "lang" else value(c) for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id."""
    ready(spark)
    return simhash.one_per_group(docs)


def string_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that start earlier; n_chars follows the text."""
    ready(spark)
    left = suffix_dedup.deduplicated(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in left.columns else left


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    ready(spark)
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document of the mix."""
    ready(spark)
    return bpe.encoded_digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("near_dedup", near_dedup),
    ("string_dedup", string_dedup),
    ("mix", mix),
    ("tokens", tokens),
]

# The stages hash word shingles, sort suffixes and merge tokens, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
