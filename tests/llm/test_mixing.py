"""Targets by hand, tilts against a scalar solver, totals of the mix, and the mix against a brute-force version."""

import math
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from furrow.llm import mixing
from furrow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_targets(sizes):
    """sizes: source -> words; targets by repeated dealing."""
    order = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, rest = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        free -= full
    return target


def check_totals(rows, sizes):
    """rows: of the result with their source; every source is near its target."""
    want = plain_targets(sizes)
    got, least = {}, {}
    for r in rows:
        s = r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s], rel=1e-9)
        assert r["size"] == 0 and r["taken"] == 0 or r["taken"] % r["size"] == 0 and 0 <= r["taken"] <= 2 * r["size"]
        got[s] = got.get(s, 0) + r["taken"]
        if r["size"]:
            least[s] = min(r["size"], least.get(s, r["size"]))
    for s in sizes:
        assert abs(got[s] - want[s]) <= max(0.005 * want[s], least.get(s, 0)), s


def plain_rates(sizes, target):
    """Rate of every size but 0: a Newton step on the logarithm of the words, or half of the bracket where that leaves it."""
    words = sum(sizes)
    if target >= 2 * words:
        return lambda size: 2.0
    scale, tilt, low, high = words / len(sizes), 0.0, -math.inf, math.inf
    while True:
        rates = [math.exp(min(tilt * s / scale, math.log(2))) for s in sizes]
        ratio = sum(s * r for s, r in zip(sizes, rates)) / target
        if abs(ratio - 1) <= mixing.NEAR:
            return lambda size: math.exp(min(tilt * size / scale, math.log(2)))
        slope = sum(s * r * s / scale for s, r in zip(sizes, rates) if tilt * s / scale < math.log(2))
        low, high = (tilt, high) if ratio < 1 else (low, tilt)
        after = tilt - math.log(ratio) * ratio * target / slope if slope else math.nan
        middle = high * 2 - 1 if low == -math.inf else low * 2 + 1 if high == math.inf else (low + high) / 2
        tilt = after if low < after < high else middle


def plain_mix(rows, unit=1 << 30):
    """rows: (doc_id, text, source); doc_id, size, source_size, target, taken of each."""
    docs = []
    for doc_id, text, source in rows:
        mark = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", doc_id), seed=42)))[0]
        docs.append({"id": doc_id, "size": len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), "source": source, "mark": mark})
    sizes = {}
    for d in docs:
        sizes.setdefault(d["source"], []).append(d["size"])
    target = plain_targets({s: sum(of) for s, of in sizes.items()})
    rate = {s: plain_rates([x for x in of if x], target[s]) for s, of in sizes.items() if sum(of)}
    # Copies: whole parts of rates, and one more wherever the sum of the rest passes a half.
    before = unit // 2
    for d in sorted(docs, key=lambda d: (d["source"] is None, d["source"] or "", -d["size"], d["mark"], d["id"])):
        share = round(rate[d["source"]](d["size"]) * unit) if d["size"] else unit
        after = before + share % unit
        d["copies"], before = min(2, share // unit + after // unit - before // unit), after
    for _ in range(4):
        for s in sizes:
            mine = [d for d in docs if d["source"] == s]
            short = target[s] - sum(d["size"] * d["copies"] for d in mine)
            up = 1 if short > 0 else -1
            free = [d for d in mine if d["size"] and 0 <= d["copies"] + up <= 2 and abs(abs(short) - d["size"]) < abs(short)]
            if free:
                min(free, key=lambda d: (abs(abs(short) - d["size"]), d["mark"], d["id"]))["copies"] += up
    return [(d["id"], d["size"], sum(sizes[d["source"]]), target[d["source"]], d["size"] * d["copies"]) for d in docs]


def test_mix_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()]
    got = sorted(map(tuple, QUERIES["op7_mixing"](spark, "/root/testdata/sf0.001").collect()))
    want = sorted(plain_mix(rows))
    assert [(*g[:3], g[4]) for g in got] == [(*w[:3], w[4]) for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9)


def test_query_meets_targets_and_repeats(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    first = QUERIES["op7_mixing"](spark, SF)
    rows = first.join(docs, "doc_id").collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    assert len(rows) == docs.count()
    check_totals(rows, sizes)
    again = mixing.mixed(spark.read.parquet(f"{SF}/documents.parquet").repartition(7))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_tilts_solve_the_dual(spark):
    sizes = spark.createDataFrame([("a", 5, 10), ("a", 50, 3), ("a", 700, 1), ("b", 1, 4), ("b", 9, 2), ("c", 3, 3)], "key string, size long, n long")
    targets = spark.createDataFrame([("a", 300.0, 900), ("b", 40.0, 22), ("c", 18.0, 9)], "key string, target double, source_size long")
    got = {r["key"]: r for r in mixing.tilts(sizes, targets).collect()}
    assert got["c"]["tilt"] == math.inf
    rows = sizes.collect()
    for key, target in (("a", 300.0), ("b", 40.0)):
        words = sum(r["n"] * r["size"] * min(2, math.exp(got[key]["tilt"] * r["size"] / got[key]["scale"])) for r in rows if r["key"] == key)
        assert words == pytest.approx(target, rel=1e-5)


def test_edge_cases(spark):
    rows = [(1, None, "b"), (2, "", "b"), (3, "a b c", None), (4, "a b", None), (4, "a b", None), (5, "w " * 70000, "a"), (6, "x y", "a"), (None, "q", "ü"),
            (None, " ", "only empty")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    clash = frame.selectExpr("*", "7 AS size", "8 AS key", "'m' AS mark", "9 AS target", "1 AS row")
    got = mixing.mixed(clash).withColumn("n", F.lit(1)).collect()
    assert len(got) == len(rows)
    assert {r["source_size"] for r in got if r["doc_id"] in (1, 2)} == {0}
    want = plain_targets({"a": 70002, "b": 0, "only empty": 0, "ü": 1, None: 7})
    assert {r["doc_id"]: r["target"] for r in got if r["doc_id"] in (3, 5)} == pytest.approx({3: want[None], 5: want["a"]})
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixed(frame.limit(0)).count() == 0


def test_mixed_documents_repeat_whole_rows(spark):
    frame = spark.createDataFrame([(1, "a b c d", "s", 5), (2, "e f", "t", 6), (2, "e f", "t", 6), (3, None, "t", 7)], "doc_id long, text string, source string, size int")
    copies = mixing.mixed_documents(frame).collect()
    assert {tuple(r) for r in copies} <= {tuple(r) for r in frame.collect()}
    assert sum(r["doc_id"] == 1 for r in copies) <= 2
