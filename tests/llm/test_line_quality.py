"""Base counts and line frequency against plain Python; SQL queries on the small tables."""

import glob
import os
import random

import duckdb
import pytest

from furrow.llm import line_quality
from furrow.llm.oracles import ORACLES
from furrow.llm.queries import QUERIES
from parity.check import difference


def split_words(text):
    for space in "\t\n\x0b\x0c\r":
        text = text.replace(space, " ")
    return [w for w in text.split(" ") if w]


def plain_counts(text):
    text = text or ""
    words = split_words(text)
    windows, held = {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in windows.values():
        if len(places) > 1:
            held |= {p + k for p in places for k in range(3)}
    lines = [x for x in text.split("\n") if split_words(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held)


def plain_verdicts(rows, limits):
    texts = {}
    key = lambda x: " ".join(split_words(x)).lower()
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if split_words(line):
                texts.setdefault((source, key(line)), set()).add(text)
    out = []
    for doc_id, text, source in rows:
        counts = plain_counts(text)
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        lost = sum(
            len(split_words(x))
            for x in (text or "").split("\n")
            if split_words(x) and len(texts[source, key(x)]) > limits.max_documents
        )
        out.append((doc_id, *counts, failed, not failed and counts[0] - lost >= limits.min_left * counts[0], lost))
    return sorted(out, key=str)


def test_line_frequency(spark):
    rng, rows = random.Random(8), []
    menu = " | ".join(f"Menu{i} item{i}" for i in range(40))
    for i in range(120):
        prose = " ".join(rng.choice("lorem ipsum dolor sit amet sed do eiusmod tempor ut labore".split()) + str(rng.randrange(40)) for _ in range(70))
        lines = [prose[: rng.randrange(400)], rng.choice([menu, menu.upper().replace(" ", "\t "), "own line"]), prose] if i % 3 else [menu, f"only {i} words"]
        rows.append((i, "\n".join(lines), rng.choice(["a", "b", None])))
    rows += [(200 + i, rows[0][1], "a") for i in range(30)]
    rows += [(1, None, "a"), (1, None, "a"), (2, "", None), (None, "x # y\n\nx # y\r\n \n", "c"), (9, "w " * 40000, "c"), (10, "\xa0 é漢 " * 60, "c"), (11, "a b c a b c", "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = line_quality.LineLimits(max_documents=5)
    clash = frame.selectExpr("*", "1 AS key", "'h' AS host", "2 AS n_words", "3 AS line").repartition(4)
    got = sorted(map(tuple, line_quality.judge_quality(clash, limits).collect()), key=str)
    assert got == plain_verdicts(rows, limits)
    assert any(not g[6] and not g[7] for g in got)
    assert line_quality.judge_quality(frame.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    assert difference(QUERIES[name](spark, sf_dir).toPandas(), connection.sql(ORACLES[name]).df()) == ""
