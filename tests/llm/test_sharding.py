"""Shards against plain scheduling: whole groups, balance, gapless slots."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from furrow.llm import sharding
from furrow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def plain_loads(rows, shards):
    """Loads of longest-first scheduling of whole groups, one by one."""
    groups = {}
    for _, text in rows:
        groups[text or ""] = groups.get(text or "", 0) + len((text or "").encode()) + 16
    loads = [0] * shards
    for size in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    return sorted(loads)


def check(rows, got, shards, slack):
    """rows: (doc_id, text); slack: bytes by which the loads may differ from plain scheduling's."""
    text_of = {}
    for doc_id, text in rows:
        text_of.setdefault(doc_id, []).append(text)
    assert len(got) == len(rows)
    loads, slots, places = [0] * shards, {}, {}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        mine = [t for t in text_of[r["doc_id"]] if (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) == (r["size"], r["text_crc32"])]
        assert mine
        assert places.setdefault(mine[0] or "", r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append((r["slot"], r["doc_id"]))
    for held in slots.values():
        held.sort(key=lambda s: s[0])
        assert [s for s, _ in held] == list(range(len(held)))
        ids = [d for _, d in held]
        assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert all(abs(a - b) <= slack for a, b in zip(sorted(loads), plain_loads(rows, shards)))


def test_query_over_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = QUERIES["op12_sharding"](spark, SF)
    assert out.columns == COLUMNS
    rows = list(map(tuple, docs.collect()))
    unit = sum(len((t or "").encode()) + 16 for _, t in rows) // (40 * sharding.PARTS) + 1
    check(rows, out.collect(), 40, 4 * unit)


def odd_rows(seed, n=300):
    rng = random.Random(seed)
    copy, hot = "copy " * 9, "hot ü"
    rows = [(i, rng.choice([hot, hot, copy, None, "", "x" * rng.randrange(4000), f"text {i}"])) for i in range(n)]
    return [*rows, (5, "other text of 5"), (5, "other text of 5"), (None, "no id"), (None, None), (n, "z" * 90_000)]


@pytest.mark.parametrize("shards, parts", [(40, 1000), (3, 1000), (7, 20), (1, 5)])
def test_odd_tables(spark, monkeypatch, shards, parts):
    monkeypatch.setattr(sharding, "PARTS", parts)
    rows = odd_rows(shards)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS shard", "'a' AS _key", "1 AS size").repartition(6)
    unit = sum(len((t or "").encode()) + 16 for _, t in rows) // (shards * parts) + 1
    check(rows, sharding.sharded(frame, shards).collect(), shards, 4 * unit)


def test_empty_table(spark):
    out = sharding.sharded(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == COLUMNS and out.count() == 0


def test_heap_takes_the_longest_first():
    assert scheduled_loads([(0, 7), (1, 6), (2, 5), (3, 4), (4, 3)], 2) == [11, 14]
    assert sharding.scheduled([(3, 5), (1, 5)], 2) == [(1, 0), (3, 1)]


def scheduled_loads(loads, shards):
    size, out = dict(loads), [0] * shards
    for bundle, shard in sharding.scheduled(loads, shards):
        out[shard] += size[bundle]
    return sorted(out)


def test_written_shards_hold_the_documents(spark, tmp_path):
    rows = odd_rows(8)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("de"))
    sharding.write_shards(frame, f"file://{tmp_path}/s", 4)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert set(back.columns) == {"doc_id", "text", "lang", "shard"}
    assert sorted(map(str, back.select("doc_id", "text").collect())) == sorted(map(str, frame.select("doc_id", "text").collect()))
    assert back.groupBy(F.coalesce("text", F.lit(""))).agg(F.countDistinct("shard").alias("n")).where("n > 1").isEmpty()
