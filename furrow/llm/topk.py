"""Exact top-k by integer inner product over a bit-sliced index.

Vectors are quantised to integers and stored in blocks of rows, one bitmap per component and binary digit. The score
bitmaps of a query are sums of shifted slices, added by carry-save adders; components with a negative
weight use complemented slices, so all terms are positive. The best rows are picked from the most significant
score slice downward, and rows tied at the boundary are told apart by id.

Blocks have a fixed number of rows and queries come in chunks of fixed size; every chunk meets every block once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

BLOCK_ROWS = 8192
CHUNK_QUERIES = 256
SCALE = 1024


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of every component as long; null if the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return F.when(vector.isNotNull() & finite, scaled)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; short vectors are filled with zeros, which add nothing."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat[offsets[0] : offsets[-1]].reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    for i, (start, size) in enumerate(zip(offsets, sizes)):
        out[i, :size] = flat[start : start + size]
    return out


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Booleans (..., rows) as 64-bit words (..., rows / 64), row 0 in the lowest bit."""
    rows = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-rows // 64) * 64), bool)
    padded[..., :rows] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


class Block:
    """Slices of up to ``BLOCK_ROWS`` rows: component d is ``low`` plus the binary number of its slices."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids = ids
        self.dims = values.shape[1]
        self.low = int(values.min(initial=0))
        span = int(values.max(initial=0)) - self.low
        self.bits = max(1, span.bit_length())
        shifted = (values - self.low).T
        digits = [(shifted >> b) & 1 == 1 for b in range(self.bits)]
        plain = bitmap(np.stack(digits, axis=1) if self.dims else np.zeros((0, self.bits, len(ids)), bool))
        # Slices of component d start at d * bits, complemented ones after all plain ones.
        self.slices = np.concatenate([plain, ~plain]).reshape(2 * self.dims * self.bits, -1)
        self.rows = bitmap(np.ones(len(ids), bool))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Score slices, least significant first, and what to add to their number."""
        weights = [int(x) for x in query[: self.dims]]
        terms: dict[int, list[int]] = {}
        for d, weight in enumerate(weights):
            first = (d if weight > 0 else d + self.dims) * self.bits
            size, place = abs(weight), 0
            while size:
                if size & 1:
                    for b in range(self.bits):
                        terms.setdefault(place + b, []).append(first + b)
                size >>= 1
                place += 1
        top = (1 << self.bits) - 1
        base = self.low * sum(weights) - top * sum(-w for w in weights if w < 0)
        out, carried, place = [], [], 0
        last = max(terms, default=-1)
        while place <= last or carried:
            rows = np.concatenate([self.slices[terms.get(place, [])], *carried])
            carried = []
            while len(rows) > 1:
                if len(rows) == 2:
                    carried.append(rows[:1] & rows[1:])
                    rows = rows[:1] ^ rows[1:]
                    break
                k = len(rows) // 3
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                either = a ^ b
                carried.append((a & b) | (either & c))
                rows = np.concatenate([either ^ c, rows[3 * k :]])
            out.append(rows[0] if len(rows) else np.zeros_like(self.rows))
            place += 1
        return out, base

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, ties to smaller ids; rows with the query's own id take no part."""
        slices, base = self.scores(query)
        tied = self.rows & ~bitmap(self.ids == query_id)
        sure = np.zeros_like(tied)
        for s in reversed(slices):
            more = sure | (tied & s)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                tied &= s
            else:
                sure = more
                tied = tied & ~s
                if n == k:
                    tied = np.zeros_like(tied)
                    break
        chosen = _places(sure)
        left = k - len(chosen)
        if left > 0:
            boundary = _places(tied)
            if len(boundary) > left:
                boundary = boundary[np.argsort(self.ids[boundary], kind="stable")[:left]]
            chosen = np.concatenate([chosen, boundary])
        word, shift = chosen // 64, (chosen % 64).astype(np.uint64)
        score = np.full(len(chosen), base, np.int64)
        for i, s in enumerate(slices):
            score += ((s[word] >> shift) & np.uint64(1)).astype(np.int64) << i
        return self.ids[chosen], score


def _places(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def _packed(batches: Iterator[pa.RecordBatch], rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) of a task packed in pieces of ``rows``: part, seq, n, dims, ids, values."""
    part, seq, ids, vectors = TaskContext.get().partitionId(), 0, [], []

    def piece() -> pa.RecordBatch:
        all_ids = np.concatenate(ids)
        dims = max(v.shape[1] for v in vectors)
        values = np.concatenate([np.pad(v, ((0, 0), (0, dims - v.shape[1]))) for v in vectors])
        fields = [part, seq, len(all_ids), dims, all_ids.astype("<i8").tobytes(), values.astype("<i8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(fields, schema)], schema=schema)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = batch.slice(at, rows - sum(map(len, ids)))
            at += take.num_rows
            ids.append(take.column(0).to_numpy(zero_copy_only=False))
            vectors.append(_matrix(take.column(1)))
            if sum(map(len, ids)) == rows:
                yield piece()
                seq, ids, vectors = seq + 1, [], []
    if ids:
        yield piece()


def _pieces(vectors: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``vectors(vec_id, v)`` packed in pieces numbered from 0 on in column ``piece``, and their number.

    The number of pieces of each task goes to the driver, nothing else.
    """
    schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("dims", pa.int32()), ("ids", pa.binary()), ("vals", pa.binary())]
    )
    task = lambda batches: _packed(batches, rows, schema)
    packed = vectors.mapInArrow(task, "part int, seq int, n int, dims int, ids binary, vals binary")
    stored = written(packed, "pieces")
    offsets, total = [], 0
    for row in stored.groupBy("part").count().orderBy("part").collect():
        offsets.append((row["part"], total))
        total += row["count"]
    first = vectors.sparkSession.createDataFrame(offsets, "part int, first int")
    return stored.join(F.broadcast(first), "part").withColumn("piece", F.col("first") + F.col("seq")), total


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k rows of ``vectors`` with the highest integer inner product with each row of ``queries``.

    Both have vec_id and embedding. Vectors that are null or hold null or non-finite components take no part, on
    either side. Components missing from the shorter of two vectors count as 0. Rows with the query's own id are
    no candidates; equal query rows are one query, and rows that repeat a candidate's id are candidates each.
    Null ids take no part. Without valid vectors the result is empty; other columns are ignored.

    Returns query_id, rank, vec_id, score.
    """
    valid = lambda df: (
        df.select("vec_id", quantised(F.col("embedding")).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    )
    blocks, n_blocks = _pieces(valid(vectors), BLOCK_ROWS)
    chunks, _ = _pieces(valid(queries).dropDuplicates(), CHUNK_QUERIES)
    names = ("n", "dims", "ids", "vals")
    spread = chunks.select(
        F.col("piece").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks, 1) - 1))).alias("piece"),
        *[F.col(c).alias(f"q_{c}") for c in names],
    )
    met = blocks.select("piece", *names).join(spread, "piece")
    schema = pa.schema([("query_id", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Block | None] = (-1, None)
        for batch in batches:
            for row in batch.to_pylist():
                if held[0] != row["piece"]:
                    ids = np.frombuffer(row["ids"], "<i8")
                    values = np.frombuffer(row["vals"], "<i8").reshape(row["n"], row["dims"])
                    held = (row["piece"], Block(ids, values))
                query_ids = np.frombuffer(row["q_ids"], "<i8")
                values = np.frombuffer(row["q_vals"], "<i8").reshape(row["q_n"], row["q_dims"])
                found = [held[1].best(int(i), v, k) for i, v in zip(query_ids, values)]
                sizes = [len(ids) for ids, _ in found]
                numbers = row["chunk"] * CHUNK_QUERIES + np.arange(len(found))
                columns = [
                    np.repeat(query_ids, sizes),
                    np.repeat(numbers, sizes),
                    np.concatenate([ids for ids, _ in found]),
                    np.concatenate([score for _, score in found]),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    best = met.mapInArrow(task, "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
