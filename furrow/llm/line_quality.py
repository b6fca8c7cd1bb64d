"""Quality rules with the frequency of lines across the documents of a host. DataFrame functions only.

A line that many different documents of one host hold is page furniture. Lines are normalised (lower case, spaces
collapsed), hashed, and counted over the documents of their host; documents of one text count once, for copies
are the business of deduplication. Lines above the limit are taken out, and a document left with too few of
its words is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import HAS_WORD, WORD_BREAK, settled, word_count, words_of, written


@dataclass(frozen=True)
class LineLimits:
    """A line goes when more than ``max_documents`` different documents of its host hold it, however large the host is; a
    document goes when less than ``min_left`` of its words stay."""

    max_documents: int = 20
    min_left: float = 0.5


# Base rules of the contract.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"


def normal_line(line: Column) -> Column:
    """Lower-cased, runs of spaces as one, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, WORD_BREAK, " ")))


def _with_counts(docs: DataFrame, text: str) -> DataFrame:
    """Add the word, symbol and repetition counts of every document.

    Arrays that lambdas look into are computed behind one-row generators, so each is built once.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: line.rlike(HAS_WORD)
    wide = settled(docs, _words=words_of(raw), _lines=F.filter(F.split(raw, "\n"), has_word))
    word, n = lambda i: F.get(F.col("_words"), i), F.size("_words")
    window = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))
    empty = F.array().cast("array<bigint>")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(empty)
    hashed = settled(wide, _windows=windows)
    # Only texts with a repeated window are sorted: places by hash, equal neighbours are repeats.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    place = lambda h, i: F.struct(h.alias("h"), i.alias("at"))
    places = F.when(repeats, F.array_sort(F.transform("_windows", place)))
    ordered = settled(hashed, _places=places)
    hash_at = lambda i: F.get(F.col("_places"), i)["h"]
    twice = lambda x, i: (hash_at(i + 1) == x["h"]).eqNullSafe(True) | (hash_at(i - 1) == x["h"]).eqNullSafe(True)
    reach = lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2)
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.filter("_places", twice), reach))))
    letters = F.length(F.regexp_replace(raw, WORD_BREAK, ""))
    return ordered.select(
        *docs.columns,
        n.cast("long").alias("n_words"),
        letters.cast("long").alias("word_chars"),
        (F.length(raw) - F.length(F.regexp_replace(raw, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_places").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"),
    )


def furniture_words(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Words in lines above the limit, per distinct text that has such lines: host, text key, furniture.

    ``docs(host, text)``, read once. A line counts once per distinct text of its host. Rows that are shuffled hold a few
    numbers per line, grouped first by text and line, then by line, so neither a host nor a line is a group.
    """
    text = F.col("text")
    lines = docs.where(text.isNotNull()).select("host", F.xxhash64(text).alias("key"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    has_word, first = F.col("line").rlike(HAS_WORD), F.col("at") == 0
    # Every row has one first line, which counts the rows of equal texts also where it has no word.
    rows = lines.where(has_word | first).select(
        "host", "key", F.when(has_word, F.xxhash64(normal_line(F.col("line")))).alias("line"),
        F.when(has_word, word_count(F.col("line"))).otherwise(F.lit(0)).alias("words"), first.cast("long").alias("copies"),
    )
    held = rows.groupBy("host", "key", "line").agg(F.sum("words").alias("words"), F.sum("copies").alias("copies"))
    held = written(held, "lines")
    often = (
        held.where("line IS NOT NULL")
        .groupBy("host", "line")
        .agg(F.count("*").alias("texts"))
        .where(F.col("texts") > limits.max_documents)
        .select(F.col("host").alias("often_host"), F.col("line").alias("often_line"), F.lit(True).alias("often"))
    )
    marked = held.join(often, F.col("host").eqNullSafe(F.col("often_host")) & (F.col("line") == F.col("often_line")), "left")
    counted = marked.groupBy("host", "key").agg(F.sum(F.when(F.col("often"), F.col("words"))).alias("words"), F.sum("copies").alias("copies"))
    # Rows of equal texts are equal: their number divides out.
    furniture = (F.col("words") / F.col("copies")).cast("long")
    return counted.where("words > 0").select("host", "key", furniture.alias("furniture"))


def judge_quality(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """Judge every row of ``docs(doc_id, text, source)``; the source is the host.

    Null and empty texts have no words and fail the base rules. A null source is a host of its own. Rows with the same
    doc_id are judged one by one. An empty table gives no rows; other columns are ignored. Lines are those between
    newlines that hold a word.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, furniture_words.
    """
    base = docs.select("doc_id", "text", F.col("source").alias("host"))
    gone = furniture_words(base.select("host", "text"), limits).select(
        F.col("host").alias("g_host"), F.col("key").alias("g_key"), "furniture"
    )
    counts = _with_counts(base.withColumn("key", F.xxhash64("text")), "text").drop("text")
    joined = counts.join(
        gone, F.col("host").eqNullSafe(F.col("g_host")) & (F.col("key") == F.col("g_key")), "left"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    lost = F.coalesce(F.col("furniture"), F.lit(0))
    left = F.col("n_words") - lost
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= limits.min_left * F.col("n_words"))).alias("kept"),
        lost.alias("furniture_words"),
    )
