"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent letter n-grams in order. A text's own most frequent n-grams are compared with
every profile: each adds the difference of its two ranks, or the profile's length where it is missing. The language
with the smallest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

UNKNOWN = "und"
LETTER_BITS = 10


@dataclass(frozen=True)
class ProfileSettings:
    """grams: longest n-gram (3 at most). profile: n-grams of a profile. sample: labelled documents per language,
    on average, that profiles are learned from; which ones is decided by a hash of id and text."""

    grams: int = 3
    profile: int = 400
    sample: int = 4000


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str, grams: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of the lower-cased words of a text, in ascending order of their numbers, and how often they occur.

    Words are runs of letters; bigrams and trigrams see one space, number 1, before and after each. A letter's number is
    its code point's lowest ten bits (2 at least), so letters of most alphabets stay apart from Latin ones.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[codes]
    if not is_letter.any():
        return np.array([], np.uint32), np.array([], np.int64)
    mask = np.uint32((1 << LETTER_BITS) - 1)
    folded = np.maximum(codes & mask, np.uint32(2))
    folded[~is_letter] = 1
    # One space between words and at both ends.
    spaced = np.concatenate([[1], folded, [1]]).astype(np.uint32)
    first_space = np.r_[True, (spaced[1:] != 1) | (spaced[:-1] != 1)]
    spaced = spaced[first_space]
    found = [spaced[spaced != 1]]
    for n in range(2, grams + 1):
        key = np.zeros(max(0, len(spaced) - n + 1), np.uint32)
        for i in range(n):
            key = (key << np.uint32(LETTER_BITS)) | spaced[i : len(spaced) - n + 1 + i]
        middle_space = np.zeros(len(key), bool)
        for i in range(1, n - 1):
            middle_space |= spaced[i : len(spaced) - n + 1 + i] == 1
        found.append(key[~middle_space])
    ordered = np.sort(np.concatenate(found))
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], np.diff(np.r_[starts, len(ordered)])


class Profiles:
    """Profiles of all languages side by side: per n-gram its rank in each language, or the profile's length."""

    def __init__(self, rows: list[tuple[str, int, int]], settings: ProfileSettings):
        """rows: language, n-gram, rank from 0."""
        self.settings = settings
        self.languages = sorted({r[0] for r in rows})
        column = {name: i for i, name in enumerate(self.languages)}
        self.keys = np.array(sorted({r[1] for r in rows}), np.uint32)
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), settings.profile, np.int64)
        at = np.searchsorted(self.keys, np.array([r[1] for r in rows], np.uint32))
        for (name, _, rank), row in zip(rows, at):
            self.ranks[row, column[name]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 less the share of the greatest possible distance; unknown without letters."""
        keys, counts = gram_counts(text or "", self.settings.grams)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        top = np.argsort(-counts, kind="stable")[: self.settings.profile]
        own = keys[top]
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        row = np.where(self.keys[at] == own, at, len(self.keys))
        ranks = self.ranks[row]
        apart = np.abs(ranks - np.arange(len(own))[:, None])
        apart[ranks == self.settings.profile] = self.settings.profile
        distance = apart.sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], 1.0 - float(distance[best]) / (len(own) * self.settings.profile)


def held_out(doc_id: str = "doc_id"):
    """Whether the crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_profiles(docs: DataFrame, settings: ProfileSettings = ProfileSettings()) -> list[tuple[str, int, int]]:
    """Rows (language, n-gram, rank) of the profiles of ``docs(doc_id, text, lang)``.

    Learns from rows with a text and a language that are not held out: from about ``sample`` rows per language.
    n-grams are counted per task, summed in a shuffle and ranked; ``profile`` rows per language reach the driver.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))
    share = F.least(F.lit(1.0), settings.sample / F.col("size"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(sizes), "lang").where(place < share).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: dict[str, list] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counted.setdefault(name, []).append(gram_counts(text.as_py(), settings.grams))
            for name, parts in counted.items():
                keys = np.concatenate([k for k, _ in parts]).astype(np.int64)
                grams, inverse = np.unique(keys, return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([c for _, c in parts]), len(grams)).astype(np.int64)
                columns = [pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    counts = sample.mapInArrow(task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < settings.profile)
    return [(r["lang"], r["gram"], r["rank"]) for r in ranked.collect()]


def identify(docs: DataFrame, profiles: list[tuple[str, int, int]], settings: ProfileSettings = ProfileSettings()) -> DataFrame:
    """Add lang_pred and score to every row of ``docs``, from its whole ``text`` alone."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*names)
    at = names.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, settings)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            extra = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "lang_pred", "score"])

    schema = StructType([*rows.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return rows.mapInArrow(task, schema)


def with_letters(docs: DataFrame, settings: ProfileSettings = ProfileSettings()) -> DataFrame:
    """Rows of ``docs`` whose ``text`` has n-grams to tell a language by, known or not."""
    at = docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [len(gram_counts(t.as_py() or "", settings.grams)[0]) > 0 for t in batch.column(at)]
            yield batch.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def predicted_languages(docs: DataFrame, settings: ProfileSettings = ProfileSettings()) -> DataFrame:
    """Predict the language of every row of ``docs(doc_id, text, lang)``.

    Learns from the rows that are not held out. Texts that are null or have no letter are ``und`` with score 0, and so
    are all if nothing could be learned. Equal distances go to the language first in code point order. Repeated rows
    are judged one by one. An empty table gives no rows; other columns are ignored.

    Returns doc_id, held_out, lang_pred, score.
    """
    profiles = learn_profiles(docs.select("doc_id", "text", "lang"), settings)
    judged = identify(docs.select("doc_id", "text"), profiles, settings)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
