"""Prefix trie of conversations over minimal-perfect-hash node tables.

A node is a distinct sequence of first turns; its digest is the XOR of 128-bit hashes of (place, turn) over the sequence, so
digests of all prefixes come from running aggregates over a conversation in pieces. Conversations are dealt to shards. A
shard enumerates its distinct digests, gives each a slot by a minimal perfect hash (the digest stored at the slot is
compared on every lookup) and scatters counts into flat arrays. Shards' nodes are then merged by digest, which checks that equal digests
have equal parents and equal last turns by SHA-256; by induction they are then equal sequences. Should two differ, all is done
again with other hashes.

Sums over subtrees add up in a second pass over the shards. What a node itself adds is put into the one shard that holds its smallest
member; within each shard, values go up through arrays of parent slots in the order of depth, deepest first, and a
node's total is the sum over the shards. A subtree can so be spread over any number of shards. A shard is worked on in blocks
of whole depths, of which the deepest comes first and hands its sums to the next, so that memory follows the
block's size. Only nodes with several members take part: the others have one leaf and save nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

BASES = 5
SHARE_BELOW = 9
PIECE_TURNS = 1 << 12
SHARD_ROWS = 1 << 18
CHUNK_BYTES = 1 << 20
GAMMA = 2.0
TRIES = 4


# ------------------------------------------------------------------------------------------------
# Minimal perfect hash
# ------------------------------------------------------------------------------------------------
def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


class NodeTable:
    """Slots 0 .. n-1 for n distinct 128-bit digests.

    Each level is a bitmap, on which the digests that hash to a place alone are marked; those that meet others go to the next level.
    A slot is the number of marks before its own. ``keys`` holds the digests by slot.
    """

    def __init__(self, digests: np.ndarray):
        """``digests``: two columns of distinct uint64 rows."""
        self.levels: list[tuple[np.ndarray, int]] = []
        left, placed, start = digests, [], 0
        while len(left):
            size = int(len(left) * GAMMA) + 1
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = np.cumsum(alone) - 1
            self.levels.append((np.where(alone, rank + start, -1), size))
            mine = alone[place]
            placed.append(left[mine][np.argsort(place[mine])])
            start += int(alone.sum())
            left = left[~mine]
        self.keys = np.concatenate(placed) if placed else digests[:0]

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return (_mixed(_mixed(digests[:, 0] ^ seed) + digests[:, 1]) % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """Slot of every digest, -1 where the table does not hold it."""
        out = np.full(len(digests), -1, np.int64)
        left = np.arange(len(digests))
        for level, (slot_of, size) in enumerate(self.levels):
            slot = slot_of[self._place(digests[left], level, size)]
            out[left] = slot
            left = left[slot < 0]
        held = np.flatnonzero(out >= 0)
        wrong = (self.keys[out[held]] != digests[held]).any(axis=1)
        out[held[wrong]] = -1
        return out


def distinct_digests(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distinct pairs as two uint64 columns."""
    both = np.stack([a, b], axis=1).view(np.uint64)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    return both[np.r_[True, (both[1:] != both[:-1]).any(axis=1)][: len(both)]]


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a, b], axis=1).view(np.uint64)


# ------------------------------------------------------------------------------------------------
# Rebuilt conversations
# ------------------------------------------------------------------------------------------------
def turn_rows(conversations: DataFrame) -> DataFrame:
    """Numbered turns: conv_id, i (from 1), content (SHA-256 of role and text), bytes (of the text).

    Turns of one number are ordered by their content. Sorted ranges are counted on their own and their counts are chained per
    conversation, so one of any length is spread over tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", content.alias("content"), F.octet_length(text).cast("long").alias("bytes")
    )
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    order = ["turn", "content", "_row"]
    rows = written(written(rows, "turns").repartitionByRange("conv_id", *order).withColumn("_part", F.spark_partition_id()), "ranges")
    pieces = rows.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("conv_id", "_part").orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(within)).join(pieces, ["conv_id", "_part"])
    return numbered.select("conv_id", (F.col("_at") + F.col("_before")).alias("i"), "content", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv, depth, content, bytes) of the rebuilt conversations, and (conv, length) of all of them.

    The first h turns, h under 9, come from the base conversation and the others from the conversation's own.
    """
    lengths = turns.groupBy("conv_id").agg(F.max("i").alias("own"))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARE_BELOW).alias("h")
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(BASES))).alias("base")
    based = lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("_base_own"))
    heads = F.least("h", F.coalesce("_base_own", F.lit(0))).alias("head")
    convs = lengths.select("conv_id", "own", base, shared).join(based, "base", "left").select("conv_id", "base", "h", "own", heads)
    convs = written(convs, "conversations")
    # At most 8 turns of a base, for at most 5 conversations.
    first = turns.where(F.col("i") < SHARE_BELOW).select(F.col("conv_id").alias("base"), F.col("i").alias("depth"), "content", "bytes")
    taken = convs.where("head > 0").join(first, "base").where("depth <= head").select("conv_id", "depth", "content", "bytes")
    own = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("i > h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("head")).alias("depth"), "content", "bytes")
    length = F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return taken.unionByName(own), convs.select("conv_id", length.cast("long").alias("length"))


def turn_hash(depth: Column, content: Column, salt: int) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at its place."""
    return F.xxhash64(depth, content, F.lit(2 * salt)), F.xxhash64(F.lit(2 * salt + 1), content, depth)


def digested(rows: DataFrame, salt: int) -> DataFrame:
    """Add the digests of the prefix up to each turn (a, b) and of the one before (pa, pb)."""
    x, y = turn_hash(F.col("depth").cast("long"), F.col("content"), salt)
    rows = rows.withColumns({"_x": x, "_y": y, "_piece": F.expr(f"(depth - 1) div {PIECE_TURNS}L")})
    pieces = rows.groupBy("conv_id", "_piece").agg(F.bit_xor("_x").alias("_px"), F.bit_xor("_y").alias("_py"))
    before = Window.partitionBy("conv_id").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    pieces = pieces.select("conv_id", "_piece", *[F.coalesce(F.bit_xor(c).over(before), zero).alias(n) for c, n in (("_px", "_bx"), ("_py", "_by"))])
    along = Window.partitionBy("conv_id", "_piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.withColumns({"_rx": F.bit_xor("_x").over(along), "_ry": F.bit_xor("_y").over(along)}).join(pieces, ["conv_id", "_piece"])
    a, b = F.col("_rx").bitwiseXOR(F.col("_bx")), F.col("_ry").bitwiseXOR(F.col("_by"))
    return run.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("_x")).alias("pa"), b.bitwiseXOR(F.col("_y")).alias("pb"),
        "content", "bytes",
    )


# ------------------------------------------------------------------------------------------------
# Node tables of shards
# ------------------------------------------------------------------------------------------------
NODES = "shard int, depth long, a long, b long, pa long, pb long, content binary, other binary, bytes long, n_convs long, conv_id long"
NODE_SCHEMA = pa.schema(
    [("shard", pa.int32()), *((c, pa.int64()) for c in ("depth", "a", "b", "pa", "pb")), ("content", pa.binary()), ("other", pa.binary()),
     ("bytes", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64())]
)


def shard_nodes(rows: DataFrame) -> DataFrame:
    """Nodes of each shard of ``rows(shard, conv_id, depth, a, b, pa, pb, content, bytes)`` with members and the smallest one.

    ``content`` and ``other`` differ only if rows of one digest have different turns, parents or depths.
    """

    def table(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        number = lambda c: whole.column(c).to_numpy()
        nodes = NodeTable(distinct_digests(number("a"), number("b")))
        slot, n = nodes.slots(_pairs(number("a"), number("b"))), len(nodes.keys)
        counts, least = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        np.add.at(counts, slot, 1)
        np.minimum.at(least, slot, number("conv_id"))
        some = np.zeros(n, np.int64)
        some[slot] = np.arange(len(slot))
        # Any row stands for its node; one that differs from it is kept next to it.
        content = np.array(whole.column("content").to_pylist(), object)
        other = content[some].copy()
        differs = (content != content[some[slot]]).astype(bool)
        for c in ("pa", "pb", "depth"):
            differs |= number(c) != number(c)[some[slot]]
        other[slot[differs]] = b"differs"
        taken = [number(c)[some] for c in ("depth", "a", "b", "pa", "pb")]
        columns = [np.full(n, shard), *taken, content[some], other, number("bytes")[some], counts, least]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, NODE_SCHEMA)], schema=NODE_SCHEMA)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard = [], 0, None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(numbers)), np.flatnonzero(numbers[1:] != numbers[:-1]) + 1):
                if not len(part):
                    continue
                # A shard may be cut anywhere: its nodes are merged with the others' anyway.
                if held and (size >= SHARD_ROWS or numbers[part[0]] != shard):
                    yield table(shard, held)
                    held, size = [], 0
                shard = int(numbers[part[0]])
                held.append(batch.slice(int(part[0]), len(part)))
                size += len(part)
        if held:
            yield table(shard, held)

    ordered = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"))
    return ordered.select("shard", "conv_id", "depth", "a", "b", "pa", "pb", "content", "bytes").mapInArrow(task, NODES)


SUMS = "a long, b long, saved long, leaves long, parent_conv_id long"
SUM_SCHEMA = pa.schema([(c, pa.int64()) for c in ("a", "b", "saved", "leaves", "parent_conv_id")])


def subtree_sums(rows: DataFrame) -> DataFrame:
    """Sums over the subtrees within each shard of ``rows(shard, depth, a, b, pa, pb, saved, leaves, conv_id)``.

    Rows are what nodes add themselves; a node may have several. ``parent_conv_id`` is the parent's conv_id.
    """

    class Shard:
        def __init__(self) -> None:
            self.carried = np.zeros((0, 6), np.int64)  # a, b, saved, leaves of parents to come; own a, b of their children

        def block(self, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            number = {c: whole.column(c).to_numpy() for c in whole.column_names}
            nodes = NodeTable(distinct_digests(number["a"], number["b"]))
            slot, n = nodes.slots(_pairs(number["a"], number["b"])), len(nodes.keys)
            sums, depth, conv, parent = np.zeros((n, 2), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
            np.add.at(sums, slot, np.stack([number["saved"], number["leaves"]], axis=1))
            depth[slot], conv[slot], parent[slot] = number["depth"], number["conv_id"], np.stack([number["pa"], number["pb"]], axis=1)
            keys = nodes.keys.view(np.int64)
            if len(self.carried):
                # Children that came with deeper blocks; their parents are here, at the block's greatest depth.
                up = nodes.slots(self.carried[:, :2].copy().view(np.uint64))
                np.add.at(sums, up, self.carried[:, 2:4])
                yield self._rows(self.carried[:, 4:6], np.zeros((len(up), 2), np.int64), conv[up])
            parent_slot = nodes.slots(parent.view(np.uint64))
            for level in np.unique(depth)[::-1]:
                at = np.flatnonzero((depth == level) & (parent_slot >= 0))
                np.add.at(sums, parent_slot[at], sums[at])
            known = parent_slot >= 0
            root = depth == 0
            yield self._rows(keys[known], sums[known], conv[parent_slot[known]])
            yield self._rows(keys[~known], sums[~known], None)
            waiting = ~known & ~root
            self.carried = np.concatenate([parent[waiting], sums[waiting], keys[waiting]], axis=1)

        @staticmethod
        def _rows(keys: np.ndarray, sums: np.ndarray, parents: np.ndarray | None) -> pa.RecordBatch:
            above = pa.nulls(len(keys), pa.int64()) if parents is None else pa.array(parents)
            columns = [*(pa.array(np.ascontiguousarray(c)) for c in (keys[:, 0], keys[:, 1], sums[:, 0], sums[:, 1])), above]
            return pa.RecordBatch.from_arrays(columns, schema=SUM_SCHEMA)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, state = [], 0, None, Shard()
        for batch in batches:
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for part in np.split(np.arange(len(key)), cuts):
                if not len(part):
                    continue
                now = tuple(key[part[0]].tolist())
                new_shard = last is not None and now[0] != last[0]
                if held and (new_shard or size >= SHARD_ROWS and now != last):
                    yield from state.block(held)
                    held, size = [], 0
                if new_shard:
                    state = Shard()
                held.append(batch.slice(int(part[0]), len(part)))
                size += len(part)
                last = now
        if held:
            yield from state.block(held)

    ordered = rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"))
    return ordered.select("shard", "depth", "a", "b", "pa", "pb", "saved", "leaves", "conv_id").mapInArrow(task, SUMS)


# ------------------------------------------------------------------------------------------------
# Members that end at a node
# ------------------------------------------------------------------------------------------------
def end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined conv_ids of every node of ``ends(a, b, conv_id)``: a, b, ends_sha256.

    Sorted ranges join their ids to texts of bounded size; the digest of a node then reads these in order.
    """
    pieces = "a long, b long, first long, text string"
    piece_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("first", pa.int64()), ("text", pa.string())])
    digest_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, out = None, [], 0, []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), piece_schema)]
            return pa.RecordBatch.from_arrays(columns, schema=piece_schema)

        total = 0
        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != node or size >= CHUNK_BYTES:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                        total += size
                    node, ids, size = (a, b), [], 0
                    if total >= 8 * CHUNK_BYTES or len(out) >= 50_000:
                        yield batch_of()
                        out, total = [], 0
                ids.append(conv)
                size += len(str(conv)) + 1
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        if out:
            yield batch_of()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for a, b, _, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) == node:
                    state.update(b"," + text.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), digest_schema)], schema=digest_schema)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, state.hexdigest()), digest_schema)], schema=digest_schema)

    ranged = ends.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    texts = ranged.mapInArrow(join, pieces)
    return texts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends_sha256 string")


# ------------------------------------------------------------------------------------------------
# The trie
# ------------------------------------------------------------------------------------------------
def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt ``conversations(conv_id, turn, role, text)``.

    Null roles and texts are empty; rows without a conv_id belong to no conversation and are left out. Repeated rows are turns of
    their own. An empty table gives no rows, not even a root; other columns are ignored.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    turns = written(turn_rows(conversations), "numbered")
    rows, convs = rebuilt(turns)
    rows, convs = written(rows, "rebuilt"), written(convs, "lengths")
    n_rows = rows.count() + convs.count()
    shards = max(1, -(-n_rows // SHARD_ROWS))
    zero = F.lit(0).cast("long")
    for salt in range(TRIES):
        paths = written(digested(rows, salt), "paths")
        root = convs.select(
            "conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("a", "b")], F.lit(-1).cast("long").alias("pa"), zero.alias("pb"),
            F.lit(b"").alias("content"), zero.alias("bytes"),
        )
        shard = F.pmod(F.xxhash64("conv_id"), F.lit(shards)).cast("int").alias("shard")
        local = written(shard_nodes(paths.unionByName(root).select("*", shard)), "shards")
        same = ["depth", "pa", "pb", "bytes"]
        merged = local.groupBy("a", "b").agg(
            *[F.min(c).alias(c) for c in same], F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.bool_or(F.col("content") != F.col("other")).alias("_mixed"),
            *[F.max(c).alias(f"_{c}") for c in same], F.min("content").alias("_low"), F.max("content").alias("_high"),
        )
        clash = F.col("_mixed") | (F.col("_low") != F.col("_high"))
        for c in same:
            clash = clash | (F.col(c) != F.col(f"_{c}"))
        nodes = written(merged.select("a", "b", *same, "n_convs", "conv_id", clash.alias("clash")), "nodes")
        if nodes.where("clash").isEmpty():
            break
    else:
        raise RuntimeError(f"{TRIES} kinds of digests collided")
    nodes = nodes.drop("clash")

    # By parents: a hot one's children are counted before the shuffle.
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("_single")
    )
    nodes = written(
        nodes.join(children, ["a", "b"], "left").fillna(0, ["n_children", "_single"]).withColumn(
            "_saved", (F.col("n_convs") - 1) * F.col("bytes")
        ).withColumn("_leaves", F.col("_single") + (F.col("n_children") == 0).cast("int")),
        "counted",
    )
    # Every single-member node below a single-member one has that member; the first of them has a parent that is shared.
    own = nodes.where((F.col("n_convs") > 1) | (F.col("depth") == 0)).select("a", "b", F.col("conv_id").alias("_conv"), "_saved", "_leaves")
    top = nodes.where("n_convs = 1 AND depth > 0").groupBy("conv_id").agg(F.min(F.struct("depth", "a", "b")).alias("top"))
    own = own.unionByName(top.select("top.a", "top.b", F.col("conv_id").alias("_conv"), zero.alias("_saved"), zero.alias("_leaves")))
    mine = F.col("conv_id") == F.col("_conv")
    value = lambda c: F.when(mine, F.col(c)).otherwise(zero)
    shared = local.join(own, ["a", "b"]).select(
        "shard", "depth", "a", "b", "pa", "pb", value("_saved").alias("saved"), value("_leaves").alias("leaves"), F.col("_conv").alias("conv_id")
    )
    sums = subtree_sums(shared).groupBy("a", "b").agg(
        F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.max("parent_conv_id").alias("above")
    )
    last = paths.join(convs, "conv_id").where("depth = length").select("a", "b", "conv_id")
    ends = end_digests(last.unionByName(convs.where("length = 0").select(zero.alias("a"), zero.alias("b"), "conv_id")))
    whole = nodes.join(sums, ["a", "b"], "left").join(ends, ["a", "b"], "left")
    single = (F.col("n_convs") == 1) & (F.col("depth") > 0)
    parent = F.when(single, F.coalesce("above", "conv_id")).otherwise(F.col("above"))
    return whole.select(
        "conv_id",
        "depth",
        parent.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.when(single, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.when(single, F.lit(0)).otherwise(F.col("saved")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
