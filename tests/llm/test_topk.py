"""Bit-sliced top-k against plain integer products."""

import math
import random

import numpy as np
import pytest

from furrow.llm import topk


def plain_top(rows, queries, k):
    valid = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and valid(v)]
    out = []
    for q, v in {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in queries if i is not None and valid(v)}:
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed, dims, n, k", [(1, 8, 300, 10), (2, 1, 70, 3), (3, 5, 9, 10), (4, 64, 200, 10)])
def test_small_blocks(spark, monkeypatch, seed, dims, n, k):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "CHUNK_QUERIES", 3)
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.uniform(-3, 3), 0.0, 0.25, -1.0]) for _ in range(dims)]) for i in range(n)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), k)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, [r for r in rows if r[0] % 20 == 0], k)


def test_edge_cases(spark):
    nan, big = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [-big, 0.0]), (None, [9.0, 9.0]),
            (6, [1.0]), (7, []), (8, [0.5, -2.0, 3.0]), (100, [0.0, 0.0]), (200, [-1.0, 0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS piece", "3 AS v")
    got = topk.top_k(frame, frame.where("vec_id % 100 = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(rows, [r for r in rows if r[0] is not None and r[0] % 100 == 0], 10)
    assert topk.top_k(frame.where("vec_id in (2, 3)"), frame).count() == 0
    assert topk.top_k(frame, frame.limit(0)).count() == 0
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0


def test_many_ties_go_to_small_ids(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)], "vec_id long, embedding array<float>")
    got = topk.top_k(frame, frame.where("vec_id = 3")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_scores_of_wide_numbers():
    rng = np.random.default_rng(1)
    values = rng.integers(-(1 << 20), 1 << 20, (130, 7))
    block = topk.Block(np.arange(130), values)
    query = rng.integers(-(1 << 18), 1 << 18, 7)
    ids, scores = block.best(-1, query, 130)
    assert (values[ids] @ query == scores).all() and len(ids) == 130
