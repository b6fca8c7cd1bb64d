"""The prefix trie against plain dictionaries and SQL; the minimal perfect hash on its own."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import prefix_trie
from furrow.llm.oracles import ORACLES
from furrow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in children[node]) if children[node] else 1
        own_saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own_saved + sum(saved[k] for k in children[node])
    return sorted(
        (members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest())
        for n in members
    )


def plain_rows(frame):
    return sorted(map(tuple, frame.select("conv_id", "turn", "role", "text").collect()), key=str)


def result(out):
    assert out.columns == COLUMNS
    return sorted(map(tuple, out.collect()))


def test_query_matches_plain_and_sql(spark):
    got = result(QUERIES["op11_prefix_trie"](spark, SF))
    assert got == plain_trie(plain_rows(spark.read.parquet(f"{SF}/conversations.parquet")))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    sql = connection.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_prefix_trie']})").fetchall()
    assert sorted(sql) == got


def planted(seed):
    """Copies of conversations, common beginnings, gaps, ties in no turn, one long conversation and its copy."""
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "tool", None]), rng.choice(["a", "b", "", None, "längerer Text", "x" * 50]))
    pool = [[say() for _ in range(rng.randrange(1, 14))] for _ in range(6)]
    rows = []
    for conv in range(150):
        if conv % 11 == 3:
            continue
        turns = [*rng.choice(pool)[: rng.randrange(1, 14)], *([say()] if rng.random() < 0.5 else [])]
        places = [None, *range(1, len(turns))] if rng.random() < 0.3 else range(10, 10 + 2 * len(turns), 2)
        rows += [(conv, place, *turn) for place, turn in zip(places, turns)]
    long = [say() for _ in range(400)]
    for conv in (1001, 1003):
        rows += [(conv, i, *turn) for i, turn in enumerate(long[: conv - 700])]
    return [*rows, (None, 1, "user", "nobody"), (7, 1, "user", "twice"), (7, 1, "user", "twice"), (-3, 1, "user", "a")]


@pytest.mark.parametrize("seed, shard, piece", [(1, 1 << 18, 1 << 12), (2, 60, 7), (3, 300, 64), (4, 9, 5)])
def test_planted_conversations(spark, monkeypatch, seed, shard, piece):
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard)
    monkeypatch.setattr(prefix_trie, "PIECE_TURNS", piece)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 5)
    rows = planted(seed)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS a", "'x' AS depth", "2 AS i")
    got = result(prefix_trie.prefix_trie(frame.repartition(5)))
    assert got == plain_trie(rows)
    assert sum(r[6] for r in got) > 0


def test_colliding_digests_are_noticed(spark, monkeypatch):
    strong, used = prefix_trie.turn_hash, []

    def weak(depth, content, salt):
        used.append(salt)
        x, y = strong(depth, content, salt)
        return (F.pmod(x, F.lit(4)), F.lit(0).cast("long")) if salt < 2 else (x, y)

    monkeypatch.setattr(prefix_trie, "turn_hash", weak)
    rows = planted(5)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert result(prefix_trie.prefix_trie(frame)) == plain_trie(rows)
    assert used == [0, 1, 2]
    monkeypatch.setattr(prefix_trie, "TRIES", 1)
    with pytest.raises(RuntimeError):
        prefix_trie.prefix_trie(frame)


def test_empty_and_single(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(12, 1, "user", "a")], [(2, None, None, None)], [(5, 1, "u", "a"), (6, 1, "u", "a")]):
        assert result(prefix_trie.prefix_trie(spark.createDataFrame(rows, schema))) == plain_trie(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    digests = prefix_trie.distinct_digests(*rng.integers(-(1 << 62), 1 << 62, (2, n)))
    digests[: n // 2, 0] = 5
    table = prefix_trie.NodeTable(digests)
    slots = table.slots(digests)
    assert sorted(slots.tolist()) == list(range(n)) and (table.keys[slots] == digests).all()
    others = digests.copy()
    others[:, 1] ^= np.uint64(1 << 63)
    assert (table.slots(others) == -1).all()
