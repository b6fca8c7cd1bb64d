"""Rank-order profiles: the measure by hand, a brute-force version, held-out accuracy, edge cases."""

import zlib
from collections import Counter

import numpy as np
import pytest

from furrow.llm import language
from furrow.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_grams(text, grams=3):
    """n-grams with counts, from padded words."""
    words, counts = "".join(c if c.isalpha() else " " for c in text.lower()).split(), {}
    number = lambda gram: sum((max(2, ord(c) & 1023) if c != " " else 1) << 10 * (len(gram) - 1 - i) for i, c in enumerate(gram))
    for word in words:
        for c in word:
            counts[number(c)] = counts.get(number(c), 0) + 1
    joined = " " + " ".join(words) + " "
    for n in range(2, grams + 1):
        for i in range(len(joined) - n + 1):
            gram = joined[i : i + n]
            if " " not in gram[1:-1] and gram.strip():
                counts[number(gram)] = counts.get(number(gram), 0) + 1
    return counts


@pytest.mark.parametrize("text", ["The then, THE!", "à l'été 12x", "a", "Ωμέγα день 漢字 ab", "x" * 5000, "\n-- q"])
def test_gram_counts(text):
    keys, counts = language.gram_counts(text)
    assert dict(zip(keys.tolist(), counts.tolist())) == plain_grams(text)


def test_distance_by_hand():
    # Text "ab": grams a, b, " a", "ab", "b ", " ab", "ab " in the order of their numbers, each once.
    keys, _ = language.gram_counts("ab")
    settings = language.ProfileSettings(profile=10)
    rows = [("x", int(k), i) for i, k in enumerate(keys)] + [("y", int(keys[0]), 3)]
    model = language.Profiles(rows, settings)
    assert model.predict("ab") == ("x", 1.0)
    only_y = language.Profiles(rows[-1:], settings)
    # y knows one gram at rank 3 instead of 0; the other six are missing at 10 each.
    assert only_y.predict("ab") == ("y", 1 - (3 + 6 * 10) / (7 * 10))


def plain_predictions(rows, profile=400):
    """rows: (doc_id, text, lang); every document against every learned profile."""
    out_of = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    grams = [Counter(plain_grams(text or "")) for _, text, _ in rows]
    learned = {}
    for (i, text, lang), counts in zip(rows, grams):
        if text is not None and lang is not None and not out_of[i]:
            learned.setdefault(lang, Counter()).update(counts)
    ordered = lambda counts: sorted(counts, key=lambda g: (-counts[g], g))[:profile]
    ranks = {lang: {g: r for r, g in enumerate(ordered(counts))} for lang, counts in learned.items()}
    judged = []
    for (i, _, _), counts in zip(rows, grams):
        own = ordered(counts)
        apart = lambda known: sum(abs(known[g] - r) if g in known else profile for r, g in enumerate(own))
        distance, lang = min((apart(known), lang) for lang, known in ranks.items())
        judged.append((i, out_of[i], lang, 1 - distance / (len(own) * profile)) if own else (i, out_of[i], "und", 0.0))
    return judged


def test_predictions_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    got = sorted(map(tuple, QUERIES["op4_language"](spark, "/root/testdata/sf0.001").collect()))
    want = sorted(plain_predictions([tuple(r) for r in rows]))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    judged = QUERIES["op4_language"](spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert len(judged) > 200 and (judged.lang == judged.lang_pred).mean() > 0.98
    assert judged.score.between(0, 1).all()


def test_held_out_documents_teach_nothing(spark):
    rows = [(i, "alpha beta gamma " * 3, "aa") for i in range(40)] + [(i, "wolke regen sturm " * 3, "bb") for i in range(40, 80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    split = {r["doc_id"]: r["out"] for r in frame.select("doc_id", language.held_out().alias("out")).collect()}
    assert all(out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, out in split.items())
    lied = spark.createDataFrame([(i, t, "zz" if split[i] else n) for i, t, n in rows], frame.schema)
    assert {r["lang_pred"] for r in language.predicted_languages(lied).collect()} == {"aa", "bb"}


def test_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ;;", "en"), (None, "the cat", None), (4, "the cat " * 30000, "en"), (4, "le chat", "fr"), (4, "le chat", "fr"),
            (8, "le chien", "fr"), (9, "le chien", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'q' AS lang_pred", "1 AS score", "2 AS gram", "3 AS size")
    got = language.predicted_languages(frame)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == len(rows)
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    nothing = frame.where("doc_id = 1")
    assert [tuple(r)[2:] for r in language.predicted_languages(nothing).collect()] == [("und", 0.0)]
    assert language.predicted_languages(frame.limit(0)).count() == 0


def test_rare_letters_fold_to_ten_bits():
    assert language.gram_counts(chr(0x410))[0].tolist() == [int(k) for k in np.sort(list(plain_grams(chr(0x410))))]
