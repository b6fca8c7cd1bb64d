"""Every stage of the pipeline against brute force on what the stage before it kept."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from furrow.llm import language, mixing
from furrow.llm.queries import QUERIES
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_suffix_dedup import planted

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def cut_plain(rows, length=100):
    """Text left of each (doc_id, text), in order."""
    seen, left = set(), {}
    for doc_id, text in rows:
        content = text.encode()
        gone = np.zeros(len(content), bool)
        for i in range(len(content) - length + 1):
            part = content[i : i + length]
            gone[i : i + length] |= part in seen
            seen.add(part)
        left[doc_id] = bytes(np.frombuffer(content, np.uint8)[~gone]).decode("utf-8", "ignore")
    return left


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    extra = [(10**9 + i, t, None, None, None) for i, t in enumerate([None, "", "12 34 -", *[p for _, p in planted(5) if p]])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out.append([tuple(r) for r in docs.select(*COLUMNS).collect()])
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
        out.append([tuple(r) for r in docs.collect()])
        if name != "tokens":
            assert docs.columns == COLUMNS
    return out


def test_language_keeps_known_ones_and_fills_gaps(spark, stages):
    frame = spark.createDataFrame(stages[0], "doc_id long, text string, lang string, source string, n_chars long")
    predicted = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predicted_languages(frame).collect()}
    sure = [r for r in stages[0] if predicted[r[0]][1] >= corpus_pipeline.LEAST_SCORE]
    want = [(r[0], r[1], r[2] or predicted[r[0]][0], *r[3:]) for r in sure]
    assert sorted(stages[1], key=str) == sorted(want, key=str) and len(want) < len(stages[0])
    given = {r[0] for r in stages[0] if r[0] < 10**9 and r[1] and any(c.isalpha() for c in r[1])}
    assert given <= {r[0] for r in want}


def test_language_rejects_what_no_profile_knows(spark):
    known = [(i, f"the words of a known language number {i} are here", "en", "s", 1) for i in range(40)]
    others = [(50, "漢字仮名 交じり文", None, "s", 1), (51, "words of the known language", None, "s", 1), (52, "жжж ЩЩЩ", "ru", "s", 1), (53, "12", "en", "s", 1)]
    docs = spark.createDataFrame([*known, *others], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.where("doc_id <> 52 OR crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2")
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.known_language(spark, docs, SF).collect()}
    assert kept == {**{i: "en" for i in range(40)}, 51: "en"}


def test_one_document_of_each_group_stays(stages):
    marked = [(r[0], plain_fingerprint(r[1])) for r in stages[1]]
    component = plain_components(marked)
    want = [r for r, (d, m) in zip(stages[1], marked) if component[m] == d]
    assert sorted(stages[2], key=str) == sorted(want, key=str) and len(want) < len(stages[1])


def test_repeated_strings_go(stages):
    rows = sorted(stages[2])
    left = cut_plain([(r[0], r[1]) for r in rows])
    want = [(r[0], left[r[0]], r[2], r[3], len(left[r[0]])) for r in rows]
    assert sorted(stages[3]) == want and want != rows


def test_mix_repeats_documents(spark, stages):
    copies = {}
    for row in stages[4]:
        copies[row] = copies.get(row, 0) + 1
    assert set(copies) <= set(stages[3]) and max(copies.values()) == 2
    frame = spark.createDataFrame(stages[3], "doc_id long, text string, lang string, source string, n_chars long")
    taken = {r["doc_id"]: r for r in mixing.mixed(frame).collect()}
    size = lambda r: len(r[1].split())
    by_source = {}
    for row in stages[3]:
        n = copies.get(row, 0)
        sums = by_source.setdefault(row[3], [0, taken[row[0]]["target"], 0])
        sums[0] += n * size(row)
        sums[2] = max(sums[2], size(row))
    assert all(abs(got - want) <= 0.02 * want + most for got, want, most in by_source.values())


def test_tokens_of_the_mix(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for row in stages[4]:
        ids = tokenizer.encode(row[1], add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(stages[5]) == sorted(want)


def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    ids = {r["doc_id"] for r in got.collect()}
    kept = {r["doc_id"] for r in QUERIES["op3_simhash"](spark, SF).where("doc_id = component_id").collect()}
    assert ids <= kept


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3, [(1, "same text here", "en", "s", 3)] * 4])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
    n = docs.count()
    assert n == (1 if rows and rows[0][1] else 0) or n == 2


def test_unlabelled_texts_stay(spark):
    rows = [(i, t, None, "s", 1) for i, t in enumerate(["some words here", "漢字", None, "", "12 34 -", "a"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.known_language(spark, docs, SF)
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[1], rows[5]]
