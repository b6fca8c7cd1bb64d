"""Fingerprints and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from furrow.llm import simhash
from furrow.llm.components import connected_components
from furrow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """pairs: (doc_id, fingerprint) of every row; smallest id by fingerprint."""
    marks = sorted({m for _, m in pairs})
    root = {m: m for m in marks}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for i, a in enumerate(marks):
        for b in marks[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    best = {}
    for doc, m in pairs:
        if doc is not None:
            best[find(m)] = min(doc, best.get(find(m), doc))
    return {m: best.get(find(m)) for m in marks}


def check(rows, result):
    marked = [(d, plain_fingerprint(t)) for d, t in rows]
    component = plain_components(marked)
    want = sorted(((d, f"{m:016x}", component[m]) for d, m in marked), key=str)
    assert sorted(map(tuple, result), key=str) == want


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check([tuple(r) for r in docs], QUERIES["op3_simhash"](spark, SF).collect())


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One TWO"), (4, "one two"), (5, "a b c d"), (6, "\xa0x"), (None, "a b c d"), (None, "q r"),
            (7, "w " * 70000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "a": F.lit(0)})
    check(rows, simhash.near_duplicates(frame).collect())


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(frame).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(frame).count() == 0


@pytest.mark.parametrize("sizes", [[1, 2, 3, 40, 48], [49, 200], [700, 1, 5]])
def test_linked_rows_against_all_pairs(sizes):
    rng = np.random.default_rng(len(sizes))
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    values = base[rng.integers(0, 3, len(bucket))]
    for _ in range(4):
        values ^= np.uint64(1) << rng.integers(0, 64, len(bucket)).astype(np.uint64)
    moved, first = simhash.linked_rows(values, bucket)
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bucket[i] == bucket[j] and int(values[i] ^ values[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(values)) if find(i) != i}
    assert dict(zip(moved.tolist(), first.tolist())) == want


def test_bucket_beyond_a_tile(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", 16)
    rng = random.Random(5)
    base = rng.getrandbits(63)
    marks = {base}
    while len(marks) < 150:
        marks.add(rng.choice(sorted(marks)) ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)))
    links = simhash.fingerprint_links(spark.createDataFrame([(m,) for m in marks], "fp long"))
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = plain_components([(m, m) for m in sorted(marks)])
    assert {m: roots.get(m, m) for m in marks} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (200, 201)]
    roots = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(roots[i] == 0 for i in range(41)) and all(roots[i] == 100 for i in range(100, 160)) and roots[201] == 200
