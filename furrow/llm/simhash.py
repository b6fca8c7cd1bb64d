"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints within the radius agree on at least two of ``radius + 2`` groups of bits, so equal pairs of groups
bring every link together. Within such a bucket, fingerprints are stored as bit planes; distances of many
pairs are counted plane by plane in carry-save counters, and words of 64 pairs are dropped once all of
them exceed the radius. Buckets of any size are cut into tiles, and pairs of tiles are compared apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import cut
from .components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE_ROWS = 2048
SMALL_BUCKET = 48
ONE = np.uint64(1)


# ------------------------------------------------------------------------------------------------
# Fingerprints
# ------------------------------------------------------------------------------------------------
def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """Majority bits of the XXH64 of all word shingles; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    ones, total, digest = np.zeros(64, np.int64), 0, xxhash.xxh64_digest
    starts = max(1, len(words) - n + 1)
    for at in range(0, starts, 1 << 15):
        part = words[at : min(at + (1 << 15), starts) + n - 1]
        shingles = zip(*[part[i:] for i in range(n)]) if len(words) >= n else [words]
        hashes = b"".join([digest(b" ".join(s), SEED) for s in shingles])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(bits)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """``fp`` (the fingerprint's bits as a long) of every row of ``docs(doc_id, text)``, with doc_id or a struct's fields."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t.as_py()) for t in batch.column(0)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(marks)], [*batch.schema.names[1:], "fp"])

    keyed = docs.select("text", F.col("doc_id").cast("long")) if key is None else docs.select("text", key.alias("_key")).select("text", "_key.*")
    schema = StructType([*keyed.schema.fields[1:], StructField("fp", LongType())])
    return keyed.mapInArrow(task, schema)


# ------------------------------------------------------------------------------------------------
# Bit-sliced comparison
# ------------------------------------------------------------------------------------------------
def bit_planes(values: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of all values, 64 to a word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within_radius(differ: Callable[[int, np.ndarray], np.ndarray], valid: np.ndarray, radius: int) -> np.ndarray:
    """Bitmap of the pairs in ``valid`` whose distance is at most ``radius`` (7 at most).

    ``differ(b, words)`` gives, for the words asked for, in which pairs bit b differs.
    """
    out = np.zeros_like(valid)
    words = np.flatnonzero(valid)
    live = valid[words]
    one, two, four, over = (np.zeros(len(words), np.uint64) for _ in range(4))

    def close() -> np.ndarray:
        more, equal = over.copy(), ~over
        for plane, place in ((four, 4), (two, 2), (one, 1)):
            if radius & place:
                equal = equal & plane
            else:
                more |= equal & plane
                equal = equal & ~plane
        return live & ~more

    for b in range(0, 64, 2):
        if not len(words):
            return out
        x, y = differ(b, words), differ(b + 1, words)
        # Full adder: two planes at once into the ones; carries ripple up.
        either = one ^ x
        carry = (one & x) | (either & y)
        one = either ^ y
        next_carry = two & carry
        two ^= carry
        over |= four & next_carry
        four ^= next_carry
        if b % 8 == 6 and b >= 8:
            live = close()
            keep = live != 0
            if not keep.all():
                words, live, one, two, four, over = (v[keep] for v in (words, live, one, two, four, over))
    out[words] = close()
    return out


def _bits_set(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _packed(mask: np.ndarray, n_words: int) -> np.ndarray:
    padded = np.zeros(n_words * 64, bool)
    padded[: len(mask)] = mask
    return np.packbits(padded, bitorder="little").view("<u8")


def _joined(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge the labels of linked rows; a label is the smallest row of its set."""
    while True:
        a, b = label[left], label[right]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def linked_rows(values: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all rows within the radius in each bucket: rows and the first rows of their sets.

    ``bucket`` is sorted. Rows of small buckets are compared with the planes shifted by 1, 2, ... rows; rows of
    large ones with each query's bit broadcast over the planes of its bucket.
    """
    label = np.arange(len(values))
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.array([], int)
    sizes = np.diff(np.r_[starts, len(bucket)])
    large = np.repeat(sizes > SMALL_BUCKET, sizes)
    small = np.flatnonzero(~large & np.repeat(sizes > 1, sizes))
    if len(small):
        planes, inside = bit_planes(values[small]), bucket[small]
        planes = np.concatenate([planes, np.zeros((64, 2), np.uint64)], axis=1)
        n_words = planes.shape[1] - 2
        for shift in range(1, SMALL_BUCKET):
            same = inside[shift:] == inside[:-shift]
            if not same.any():
                break
            s, back = np.uint64(shift), np.uint64(64 - shift)
            differ = lambda b, w: planes[b, w] ^ ((planes[b, w] >> s) | (planes[b, w + 1] << back))  # noqa: B023, E731
            at = _bits_set(within_radius(differ, _packed(same, n_words), radius))
            label = _joined(label, small[at], small[at + shift])
    for start, size in zip(starts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET]):
        own = values[start : start + size]
        planes = bit_planes(own)
        n_words, lanes = planes.shape[1], np.arange(planes.shape[1] * 64)
        for first in range(0, size, 32):
            rows = np.arange(first, min(first + 32, size))
            bits = [(np.uint64(0) - ((own[rows] >> np.uint64(b)) & ONE)) for b in range(64)]
            after = (lanes[None, :] > rows[:, None]) & (lanes[None, :] < size)
            valid = np.packbits(after, axis=1, bitorder="little").view("<u8").ravel()
            differ = lambda b, w: planes[b, w % n_words] ^ bits[b][w // n_words]  # noqa: B023, E731
            at = _bits_set(within_radius(differ, valid, radius))
            label = _joined(label, start + rows[at // len(lanes)], start + at % len(lanes))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


# ------------------------------------------------------------------------------------------------
# Links between all fingerprints
# ------------------------------------------------------------------------------------------------
def bucket_keys(fp: Column, radius: int = RADIUS) -> Column:
    """One key per pair of bit groups: the pair's number and the bits of both groups."""
    groups = radius + 2
    ends = [64 * i // groups for i in range(groups + 1)]
    part = lambda i: F.shiftrightunsigned(fp, ends[i]).bitwiseAND((1 << (ends[i + 1] - ends[i])) - 1)
    keys = []
    for n, (i, j) in enumerate(combinations(range(groups), 2)):
        both = F.shiftleft(part(i), ends[j + 1] - ends[j]).bitwiseOR(part(j))
        keys.append(both.bitwiseOR(F.lit(n << 48)))
    return F.array(*keys)


def fingerprint_links(marks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a``, ``b`` that connect all of ``marks(fp)`` (distinct) within the radius of each other."""
    rows = marks.select("fp", F.explode(bucket_keys(F.col("fp"), radius)).alias("key"))
    tiles = F.ceil(F.col("n") / TILE_ROWS).cast("int")
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key", tiles.alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    met = rows.join(many, "key").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    pairs = met.select("fp", "key", "own", other).select(
        "fp", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    )
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        values, key, i, j = columns
        new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])] if len(key) else np.array([], bool)
        moved, first = linked_rows(values.view(np.uint64), np.cumsum(new), radius)
        return pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[first])], schema=schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A bucket may go on in the next batch; what is held back is at most a pair of tiles.
        held = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            if not len(columns[0]):
                continue
            last = np.logical_and.reduce([c == c[-1] for c in columns[1:]])
            cut_at = int(np.flatnonzero(last)[0])
            held = [c[cut_at:] for c in columns]
            yield links([c[:cut_at] for c in columns])
        if held is not None:
            yield links(held)

    ordered = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return ordered.mapInArrow(task, "a long, b long").distinct()


def _components(marked: DataFrame, radius: int) -> DataFrame:
    """Component of every fingerprint of ``marked(fp, first)``, named by its smallest ``first``: fp, component."""
    nodes = marked.groupBy("fp").agg(F.min("first").alias("first"))
    roots = connected_components(fingerprint_links(nodes.select("fp"), radius))
    grouped = nodes.join(roots, nodes["fp"] == roots["node"])
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component"))
    linked = grouped.join(smallest, "root").select("fp", "component")
    return nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprint and component of every row of ``docs(doc_id, text)``.

    Null texts and texts without words have fingerprint zero, which links like any other. Documents with equal
    fingerprints are one node; links are found between different fingerprints only. Rows that repeat a doc_id are
    rows of their own; null ids are never the smallest of a component unless it has no other. An empty table
    gives no rows; other columns are ignored.

    Returns doc_id, fingerprint (16 hex digits), component_id.
    """
    marked = cut(fingerprints(docs))
    every = _components(marked.select("fp", F.col("doc_id").alias("first")), radius)
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return marked.join(every, "fp").select("doc_id", hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def one_per_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The row with the smallest doc_id of every component of ``docs``, with all its columns.

    Of several rows with that id the one with the least hash of its columns stays, of equal rows one; null
    ids count as greatest.
    """
    names = docs.columns
    key = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("mark"))
    marked = cut(fingerprints(docs, key))
    kept = _components(marked.select("fp", F.struct("id", "mark").alias("first")), radius).select("component.id", "component.mark").distinct()
    rows = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    joined = rows.join(kept, (F.col("_key.id") == F.col("id")) & (F.col("_key.mark") == F.col("mark")), "left_semi")
    return joined.dropDuplicates(["_key"]).select("_row.*")
