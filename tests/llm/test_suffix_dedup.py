"""Induced sorting and removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from furrow.llm import suffix_dedup, suffix_sort
from furrow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_result(rows, length=100):
    """rows: (doc_id, text) in document order."""
    seen, out = set(), []
    for doc_id, text in rows:
        content = (text or "").encode()
        gone = np.zeros(len(content), bool)
        for i in range(len(content) - length + 1):
            part = content[i : i + length]
            if part in seen:
                gone[i : i + length] = True
            seen.add(part)
        kept = bytes(np.frombuffer(content, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc_id, len(content), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = sorted(map(tuple, QUERIES["op5_suffix_dedup"](spark, SF).collect()))
    want = plain_result(map(tuple, rows))
    assert got == want
    assert sum(w[2] for w in want) > 0


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, run = prose(60), "-" * 700
    rows = [(1, prose(80)), (2, None), (3, ""), (4, run), (5, passage + run[:250]), (6, "x" + passage), (7, "ab" * 400), (8, prose(9) + "ab" * 90)]
    base = prose(120)
    for i in range(9, 40):
        words = base.split(" ")
        words[rng.randrange(len(words))] = word()
        rows.append((i, " ".join(words)))
    rows += [(40, base), (41, base), (42, passage[:99]), (43, passage[:100]), (44, "\x00" * 150)]
    return rows


@pytest.mark.parametrize("buffer, hot", [(1 << 19, 1000), (1 << 10, 1000), (1 << 19, 1), (1 << 19, 5)])
def test_planted_repeats(spark, monkeypatch, buffer, hot):
    monkeypatch.setattr(suffix_dedup, "BUFFER", buffer)
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    suffix_dedup._POWERS.clear()
    rows = planted(buffer)
    shuffled = random.Random(1).sample(rows, len(rows))
    frame = spark.createDataFrame(shuffled, "doc_id long, text string").selectExpr("*", "1 AS slot", "'x' AS gram", "text AS row")
    got = sorted(map(tuple, suffix_dedup.deduplicated_digests(frame.repartition(5)).collect()))
    suffix_dedup._POWERS.clear()
    assert got == plain_result(rows)


def hot_rows(seed, n=150):
    """A passage and a phrase under 100 bytes, each with other neighbours in every text; one text twice, one as two rows."""
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choice("abcdefgh é") for _ in range(k))
    passage, phrase = prose(160), prose(80)
    texts = [prose(150) + (passage, phrase)[i % 2] + prose(150) + "-" * (i % 3 * 60) for i in range(n)]
    texts += [texts[0], prose(20) + phrase * 4 + prose(120)]
    return list(enumerate(texts))


@pytest.mark.parametrize("limit", [8 << 20, 40_000, 0])
def test_no_shard_grows_with_a_hot_gram(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 3)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", limit)
    monkeypatch.setattr(suffix_dedup, "KEY_ROWS", 1000)
    rows = hot_rows(11)
    frame = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string").repartition(4)
    got = sorted(set(map(tuple, suffix_dedup.deduplicated_digests(frame).collect())))
    assert got == plain_result(rows)


def test_parts_of_a_hot_gram_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 3)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 12_000)
    frame = spark.createDataFrame(hot_rows(12), "doc_id long, text string")
    keyed = suffix_dedup.keyed_documents(frame)
    suspects = suffix_dedup.met_pieces(suffix_dedup.text_pieces(keyed)).where("suspect").drop("suspect")
    parts = suffix_dedup._piece_bytes(keyed, suspects)
    largest = parts.groupBy("gram", "part").agg({"content": "count"}).selectExpr("max(`count(content)`)").first()[0]
    assert 0 < largest * 108 <= 12_000 and parts.where("content IS NULL").count() > 0


def test_repeated_rows_and_null_ids(spark):
    a, b = planted(2)[8][1], planted(3)[8][1]
    frame = spark.createDataFrame([(None, a), (5, a), (5, a), (7, b), (7, a)], "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.deduplicated_digests(frame).select("doc_id", "n_removed").collect()), key=str)
    n = len(a.encode())
    assert got == sorted([(5, 0), (5, 0), (7, 0), (7, n), (None, n)], key=str)


def test_empty_table(spark):
    assert suffix_dedup.deduplicated_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_texts_keep_columns(spark):
    text = planted(4)[0][1]
    frame = spark.createDataFrame([(1, text, "s", 1), (2, "Ü" + text + "!", "t", 2)], "doc_id long, text string, spans string, doc int")
    got = {r["doc_id"]: r for r in suffix_dedup.deduplicated(frame).collect()}
    assert got[1]["text"] == text and got[2]["text"] == "Ü!" and got[2]["spans"] == "t" and got[2]["doc"] == 2


@pytest.mark.parametrize("recurse, memory", [(1 << 22, 128 << 20), (3, 128 << 20), (1 << 22, 300), (5, 300)])
def test_induced_sorting(monkeypatch, recurse, memory):
    monkeypatch.setattr(suffix_sort, "RECURSE_ABOVE", recurse)
    monkeypatch.setattr(suffix_sort, "QUEUE_BYTES", memory)
    rng = random.Random(recurse + memory)
    for _ in range(60):
        letters = rng.choice([b"ab", b"a", b"abcde", bytes(range(97, 123)), b"\x00a"])
        base = bytes(rng.choice(letters) for _ in range(60))
        pieces = [base[(s := rng.randrange(40)) : s + rng.randrange(1, 20)] for _ in range(rng.randrange(1, 9))]
        size, seen, want = rng.choice([1, 2, 5, 9]), set(), []
        for i, p in enumerate(pieces):
            for j in range(len(p) - size + 1):
                (want.append((i, j)) if p[j : j + size] in seen else seen.add(p[j : j + size]))
        number, offset = suffix_sort.repeated(pieces, size)
        assert list(zip(number.tolist(), offset.tolist())) == want


def test_suffix_order_and_common_prefixes():
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(20)]
    text = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)
    blocks = list(suffix_sort.suffixes(text, 50))[::-1]
    order = np.concatenate([b[0] for b in blocks])
    stops = np.flatnonzero(text == 0)
    key = lambda i: (text[i : stops[np.searchsorted(stops, i)]].tobytes(), i)
    plain = sorted([i for i in range(len(text)) if text[i]], key=lambda i: (key(i)[0] + b"\x00", stops[np.searchsorted(stops, i)]))
    assert [i for i in order.tolist() if text[i]] == plain
    for at, shared in blocks:
        for a, b, n in zip(at, at[1:], shared[1:]):
            x, y = key(a)[0], key(b)[0]
            assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


@pytest.fixture
def scattered(spark):
    """Many shuffle partitions that are not put together, as on a cluster."""
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_shards_without_a_repeat(spark, scattered):
    phrase, other = "".join(chr(97 + i * i % 23) for i in range(95)), "".join(chr(65 + i * 7 % 25) for i in range(60))
    for texts in ([f"{phrase}0", f"1{phrase}"], [f"{other} - {other}"], [f"x{phrase}y", f"a{phrase}b", "z" * 40]):
        rows = [(i, t + " end of text " * 9 if i else t) for i, t in enumerate(texts)]
        got = sorted(map(tuple, suffix_dedup.deduplicated_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
        assert got == plain_result(rows)


def test_whole_table_over_many_partitions(spark, scattered):
    rows = list(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()))
    assert sorted(map(tuple, QUERIES["op5_suffix_dedup"](spark, SF).collect())) == plain_result(rows)
    few = spark.createDataFrame(rows[:10], "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.deduplicated_digests(few).collect())) == plain_result(rows[:10])


@pytest.mark.parametrize("hot", [1000, 1])
def test_built_collisions_remove_nothing(spark, monkeypatch, hot):
    """Two texts whose polynomial hashes modulo 2^64 agree for any base, with a common least 32-gram before them."""
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", 0 if hot == 1 else 8 << 20)
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    turned = word.translate({97: 98, 98: 97})
    rows = [(1, word + turned), (2, turned + word), (3, "q" + word)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.deduplicated_digests(frame).collect())) == plain_result(rows)


@pytest.mark.parametrize("known", [1 << 15, 0])
def test_copies_met_in_a_task(spark, monkeypatch, known):
    monkeypatch.setattr(suffix_dedup, "KNOWN_COPIES", known)
    monkeypatch.setattr(suffix_dedup, "BUFFER", 1 << 11)
    suffix_dedup._POWERS.clear()
    rng = random.Random(6)
    passage = planted(6)[0][1]
    rows = [(i, planted(i % 3)[8][1][: rng.randrange(200)] + passage + str(i) * 60) for i in range(60)]
    shuffled = [*rng.sample(rows, len(rows)), rows[4], rows[4]]
    frame = spark.createDataFrame(shuffled, "doc_id long, text string").coalesce(2)
    got = sorted(set(map(tuple, suffix_dedup.deduplicated_digests(frame).collect())))
    suffix_dedup._POWERS.clear()
    assert got == plain_result(rows)
