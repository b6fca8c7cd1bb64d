"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from furrow.llm import variants
from furrow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
UPPER = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_result(words):
    near = {w: [] for w in words}
    ordered = sorted(words, key=len)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if len(b) > len(a) + 1:
                break
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words)


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: r[0])


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    out = QUERIES["op13_variants"](spark, SF)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_result(plain_words(map(tuple, rows)))
    assert ordered(out.collect()) == want
    assert sum(w[1] is not None for w in want) > 0


def planted(seed):
    """Texts of words with edits of words, chains of forms, ties, runs of equal letters."""
    rng = random.Random(seed)
    letters = "abé" if seed % 2 else "abcdefghijÀÿ×"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(30)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "bbbbbbb"]
    pool = Counter()
    for base in bases:
        word, n = base, rng.choice([700, 130, 130, 30])
        while n >= 4:
            pool[word] += n
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])
            n = n // rng.choice([2, 5, 6])
    tokens = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w, n in pool.items() for _ in range(n)]
    rng.shuffle(tokens)
    texts = [rng.choice([" ", "-", "1", "\n"]).join(tokens[i : i + 50]) for i in range(0, len(tokens), 50)]
    return [*enumerate(texts), (3, texts[0]), (3, texts[0]), (None, texts[1]), (9, None), (10, ""), (11, "long" * 5000 + " tiny")]


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 7), (3, 40), (4, 16), (5, 5)])
def test_planted_variants(spark, seed, parts):
    rows = planted(seed)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS word", "2 AS n").repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered(variants.spelling_variants(frame).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = plain_result(plain_words(rows))
    assert got == want
    assert len({w[2] for w in want if w[1] and w[1] != w[2]}) > 0


def test_trie_nodes_are_prefixes(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 9))) for _ in range(200)})
    frame = spark.createDataFrame(list(enumerate(words)), "id long, key string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        paths = {words[r["id"]]: r["path"] for r in variants.trie_paths(frame).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    number = {}
    for word, path in paths.items():
        assert path[0] == 0 and len(path) == len(word) + 1
        for i in range(1, len(path)):
            assert number.setdefault(word[:i], path[i]) == path[i]
    assert sorted(number.values()) == list(range(1, len(number) + 1))


def test_empty_table(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert variants.spelling_variants(spark.createDataFrame([(1, "short words only")], "doc_id long, text string")).count() == 0
