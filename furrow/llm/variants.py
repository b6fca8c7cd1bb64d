"""Spelling variants: exact neighbours at one edit through a dictionary of trie-node pairs.

The words' prefixes are the nodes of a forward trie and their suffixes those of a reversed one, both numbered from one.
A word skipped at position i is the integer pair (prefix before i, suffix after i), a word opened at i the pair (prefix
before i, suffix from i). Two words with a common skipped pair differ by a replaced character, a skipped and an opened
pair in common mean that one word has a character more. Of a run of equal characters only the first is skipped for the
latter, so a neighbour is met once. Words that share a pair differ in one character, so the alphabet bounds their number, and
all that leaves a pair is a count and the best neighbour per word.

Numbering is one pass over sorted words: a word adds the nodes beyond its common prefix with the word before. Sorted
ranges are numbered on their own; one row per range goes to the driver, which carries the path of nodes on.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import settled, with_running_total, written

LETTERS = "A-Za-zÀ-ÿ"
ALTERED_EVERY = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
FORM_TIMES = 5
OPENED, SKIPPED, SKIPPED_FIRST = 0, 1, 2


def altered_words(docs: DataFrame) -> DataFrame:
    """Words of ``docs(doc_id, text)`` of at least 6 characters with their number (n), at least 5.

    Runs shorter than 6 give no such word and are not looked at; a null id is written as nothing.
    """
    found = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"), F.lit(1))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    lowered = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % ALTERED_EVERY == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


# ------------------------------------------------------------------------------------------------
# Tries
# ------------------------------------------------------------------------------------------------
def common_length(a: str, b: str) -> int:
    """Number of equal characters at the beginnings."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def trie_paths(words: DataFrame) -> DataFrame:
    """Node numbers of the prefixes of every word of ``words(id, key)``, by length, behind the root's 0: id, path.

    Words are distinct; equal prefixes have equal numbers in all ranges.
    """
    schema = pa.schema([("part", pa.int32()), ("id", pa.int64()), ("key", pa.string()), ("local", pa.list_(pa.int64()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, path, nodes = TaskContext.get().partitionId(), "", [], 0
        for batch in batches:
            paths = []
            for word in (keys := batch.column(1).to_pylist()):
                same = common_length(before, word)
                added = len(word) - same
                path = path[:same] + list(range(nodes + 1, nodes + added + 1))
                nodes, before = nodes + added, word
                paths.append(path)
            columns = [pa.array([part] * len(keys), pa.int32()), batch.column(0), batch.column(1), pa.array(paths, schema.field(3).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ranges = words.select("id", "key").repartitionByRange("key").sortWithinPartitions("key")
    local = written(ranges.mapInArrow(task, "part int, id long, key string, local array<long>"), "trie")
    ends = local.groupBy("part").agg(
        F.min("key").alias("first"), F.max(F.struct("key", "local")).alias("last"), F.max(F.array_max("local")).alias("nodes")
    )
    # One row per range: how many nodes its first word shares with the word before, their numbers, and the next free one.
    carried, before, path, start = [], "", [], 0
    for row in ends.orderBy("part").collect():
        same = common_length(before, row["first"])
        carried.append((row["part"], path[:same], start - same))
        before, path = row["last"]["key"], [path[x - 1] if x <= same else start - same + x for x in row["last"]["local"]]
        start += row["nodes"] - same
    table = local.sparkSession.createDataFrame(carried, "part int, shared array<long>, shift long")
    joined = local.join(F.broadcast(table), "part")
    number = lambda x: F.when(x <= F.size("shared"), F.get("shared", (x - 1).cast("int"))).otherwise(x + F.col("shift"))
    return joined.select("id", F.concat(F.array(F.lit(0).cast("long")), F.transform("local", number)).alias("path"))


# ------------------------------------------------------------------------------------------------
# Pairs
# ------------------------------------------------------------------------------------------------
def node_pairs(words: DataFrame) -> DataFrame:
    """Skipped and opened pairs of ``words(id, word, n)``: prefix, suffix, kind, n, id."""
    forward = trie_paths(words.select("id", F.col("word").alias("key")))
    backward = trie_paths(words.select("id", F.reverse("word").alias("key"))).withColumnRenamed("path", "back")
    rows = settled(words.join(forward, "id").join(backward, "id"), size=F.char_length("word"), letters=F.split("word", ""))
    node = lambda path, i: F.get(path, i)
    pair = lambda kind, i, rest: F.struct(node("path", i).alias("prefix"), node("back", rest).alias("suffix"), kind.cast("byte").alias("kind"))
    first = lambda i: (i == 0) | (F.get("letters", i) != F.get("letters", i - 1))
    skipped = F.transform(
        F.sequence(F.lit(0), F.col("size") - 1),
        lambda i: pair(F.when(first(i), SKIPPED_FIRST).otherwise(SKIPPED), i, F.col("size") - 1 - i),
    )
    opened = F.transform(F.sequence(F.lit(0), F.col("size")), lambda i: pair(F.lit(OPENED), i, F.col("size") - i))
    return rows.select("n", "id", F.inline(F.concat(skipped, opened)))


def _best(members: Column) -> Column:
    """Members in order: largest n first, ties by id, which follows code points."""
    return F.array_sort(F.transform(members, lambda m: F.struct((-m["n"]).alias("less"), m["id"].alias("id"))))


def near_words(pairs: DataFrame) -> DataFrame:
    """Number of near words and the best of them for every id that has any: id, n_near, best (less, id)."""
    shared = pairs.groupBy("prefix", "suffix").agg(F.collect_list(F.struct("kind", "n", "id")).alias("members"))
    shared = shared.where(F.size("members") > 1).select("members")
    opened = F.filter("members", lambda m: m["kind"] == OPENED)
    skipped = F.filter("members", lambda m: m["kind"] != OPENED)
    longer = F.filter("members", lambda m: m["kind"] == SKIPPED_FIRST)
    ranked = settled(shared, opened=_best(opened), skipped=_best(skipped), longer=_best(longer))

    def result(m: Column) -> Column:
        meets = (m["kind"] == SKIPPED_FIRST) & (F.size("opened") > 0)
        other = F.get("skipped", F.when(F.get("skipped", F.lit(0))["id"] == m["id"], 1).otherwise(0))
        best = F.array_min(F.filter(F.array(other, F.when(meets, F.get("opened", F.lit(0)))), lambda x: x.isNotNull()))
        number = F.size("skipped") - 1 + meets.cast("int")
        own = m["kind"] == OPENED
        return F.struct(
            m["id"].alias("id"),
            F.when(own, F.size("longer")).otherwise(number).alias("near"),
            F.when(own, F.get("longer", F.lit(0))).otherwise(best).alias("best"),
        )

    found = ranked.select(F.inline(F.transform("members", result))).where("near > 0")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Forms of the words of ``docs(doc_id, text)``.

    Null and empty texts have no words; repeated rows count each. An empty table gives no rows; other columns are ignored. Forms
    grow at least fivefold, so following them ends after a few steps: roots are handed down from words without a form to
    those that have it as theirs, of which a word's length and the alphabet bound the number.

    Returns word, form, root, n, n_near, form_n.
    """
    counted = altered_words(docs.select("doc_id", "text")).withColumn("_one", F.lit(1).cast("long"))
    words = written(with_running_total(counted, ["word"], "_one", "id").select("id", "word", "n"), "words")
    near = words.join(near_words(node_pairs(words)), "id", "left")
    has_form = -F.col("best.less") >= FORM_TIMES * F.col("n")
    form = lambda value: F.when(has_form, value)
    edges = written(
        near.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            form(F.col("best.id")).alias("form_id"), form(-F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    level = edges.where("form_id IS NULL").withColumns({"form": F.lit(None).cast("string"), "root": F.col("word")})
    done, formed = level, edges.where("form_id IS NOT NULL")
    while not level.isEmpty():
        above = level.select(F.col("id").alias("form_id"), F.col("word").alias("form"), "root")
        level = written(formed.join(above, "form_id").select(*done.columns), "roots")
        done = done.unionByName(level)
    return done.select("word", "form", "root", "n", "n_near", "form_n")
