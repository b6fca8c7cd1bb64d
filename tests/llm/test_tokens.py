"""Token files and BPE against the tokenizers library."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from furrow.llm import bpe, token_coder, token_store
from furrow.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(1)
    pool = "aA bB'sS'tT é́ß İΣσ \x1c\x85 ​12²Ⅷ٣ 漢字😀-_%%\n\t<|endoftext|>́ǅﬁK 'LL'll"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(0x300)]
    return [*texts, "ΑΣ ΟΔΥΣΣΕΥΣ", "<|startoftext|>hi<|endoftext|> <|endoftext|", "a" * 5000, "%" * 3000, "x" * 65, "", "I'LL we'Re", " \n \n"]


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def want_stored(rows):
    tokenizer, start, out = Tokenizer.from_file(BYTES), 0, []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_stored_documents(spark, documents):
    assert sorted(map(tuple, QUERIES["op1_token_store"](spark, SF).collect())) == want_stored(sorted(documents))


def test_stored_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(-5, None), (10**12, "w " * 60000)]
    frame = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "doc_id long, text string").selectExpr("*", "1 AS start", "'' AS file")
    assert sorted(map(tuple, token_store.stored_tokens(frame.repartition(4), BYTES).collect())) == want_stored(sorted(rows))
    repeated = spark.createDataFrame([(None, "a b"), (3, "x"), (3, "x"), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, token_store.stored_tokens(repeated, BYTES).collect()), key=lambda r: r[1])
    assert [g[0] for g in got] == [None, 3, 3, 3] and sorted(g[2] for g in got) == [1, 2, 2, 3]
    assert [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got[:-1]]]).tolist()
    assert token_store.stored_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


def test_pieces_of_odd_texts(monkeypatch):
    tokenizer, rng = Tokenizer.from_file(BYTES), random.Random(6)
    pool = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "7", "²", "!", "é", "\u00a0", "'S", "\u3000", "x1"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(6000)]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids.tolist() for ids in token_store.PieceTokenizer(BYTES).encode(texts)] == want
    # A table that is too small for all pieces starts anew, batches are short, and hashes meet in its slots.
    monkeypatch.setattr(token_store, "KEPT_PIECES", 300)
    monkeypatch.setattr(token_store, "BATCH_CHARS", 512)
    token_store._hash_tables.cache_clear()
    small = token_store.PieceTokenizer(BYTES)
    small.table = token_store.PieceTable(10)
    assert [ids.tolist() for ids in small.encode(texts)] == want
    token_store._hash_tables.cache_clear()


def test_pieces_of_one_hash():
    """A Thue-Morse word of 1024 letters and its complement have one polynomial hash modulo 2^64."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"x {other} {word}", word + other, "plain", f" {other}"]
    tokenizer, pieces = Tokenizer.from_file(BYTES), token_store.PieceTokenizer(BYTES)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for order in (texts, texts[::-1]):
        assert [ids.tolist() for ids in pieces.encode(order)] == (want if order is texts else want[::-1])
    with pytest.raises(ValueError, match="splits texts"):
        token_store.PieceTokenizer(WORDS)


def test_files_of_few_ids(spark, monkeypatch, documents):
    rows = sorted(documents)[:40]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(token_store, "FILE_IDS", 500)
    assert sorted(map(tuple, token_store.stored_tokens(frame, BYTES).collect())) == want_stored(rows)


@pytest.mark.parametrize("kind", ["random", "skewed", "constant", "all ids", "periodic"])
def test_coder_round_trip(kind):
    rng = np.random.default_rng(3)
    ids = {
        "random": lambda: rng.integers(0, 65536, 9000),
        "skewed": lambda: np.minimum(rng.zipf(1.3, 20000), 65535),
        "constant": lambda: np.full(10000, 65535),
        "all ids": lambda: np.arange(65536),
        "periodic": lambda: np.tile([5, 9, 5, 7, 60000], 3000),
    }[kind]().astype(np.uint16)
    blocks = [ids[i : i + 700] for i in range(0, len(ids), 700)]
    coded = token_coder.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(token_coder.decode_blocks(coded, [len(b) for b in blocks]), blocks))
    # Blocks can be decoded alone.
    assert (token_coder.decode_blocks(coded[3:4], [700])[0] == blocks[3]).all()
    if kind == "periodic":
        assert sum(map(len, coded)) < len(ids) // 4


def test_damaged_files():
    data = token_store.file_bytes([4, None], [np.array([1, 2, 0], np.uint16), np.array([0], np.uint16)])
    assert [(d, ids.tolist()) for d, ids in token_store.read_file(data)] == [(4, [1, 2, 0]), (None, [0])]
    for at in (0, len(data) // 2 - 14, len(data) - 1):
        broken = bytearray(data)
        broken[at] ^= 64
        with pytest.raises((ValueError, zlib.error)):
            list(token_store.read_file(bytes(broken)))


def want_words(rows):
    tokenizer, out = Tokenizer.from_file(WORDS), []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return out


def test_words_of_documents(spark, documents):
    assert sorted(map(tuple, QUERIES["op6_bpe"](spark, SF).collect())) == want_words(sorted(documents))


def test_words_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(-1, None), (-1, None), (None, "a b"), (7, "Long " * 40000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS n_tokens")
    assert sorted(map(tuple, bpe.encoded_digests(frame, WORDS).collect()), key=str) == sorted(want_words(rows), key=str)
    assert bpe.encoded_digests(frame.limit(0), WORDS).count() == 0


def test_words_of_newer_characters():
    """Characters that Python's tables do not assign may have letters' kinds and lower cases in the library's."""
    newer = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn"]
    newer = [c for c in newer if c < "\U00020000"] + newer[::5000]
    texts = [f"Ab{c}X {c}{c} 1{c}" for c in newer[::7]] + [f"a{c}b" for c in newer if "\u1c80" <= c <= "\u1cff" or "\ua7c0" <= c <= "\ua7ff"]
    texts += [f"É <|endoftext|>{newer[3]}<|endoftext|> Σ"]
    tokenizer = Tokenizer.from_file(WORDS)
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in bpe.WordBpe(WORDS).encode(texts)] == want


def test_long_words_merge_like_short_ones(monkeypatch):
    model = bpe.WordBpe(WORDS)
    words = [bytes(random.Random(i).choice(b"etaoin-") for _ in range(i + 1)) for i in range(60)]
    short = model.merged(words)
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    assert model.merged(words) == short
