"""WARC archives, capture index, url rules and reputation."""

import gzip
import hashlib
import os
import random
import re

import pytest

from furrow.llm import url_reputation, warc
from furrow.llm.queries import URL_RULES


def pages_frame(spark):
    rng, rows = random.Random(4), []
    for i in range(300):
        body = rng.choice(["x" * 99, "y" * 100, "é" * 50, None, "", f"<p>{i}</p>" * 20, "same body " * 12])
        url = rng.choice([f"https://A.example.com/{i % 7}?q#f", None, "no scheme", f"http://b.example.co.uk/p\n{i}", f"https://c.d.net:80/{i}"])
        rows.append((i, url, body))
    rows += [(7, "http://again", "same body " * 12), (None, None, "same body " * 12), (None, "http://n", "short"), (400, "http://long", "z" * 3_000_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string")


def plain_records(rows):
    first, out = {}, []
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(page, first.get(data, page))
    for page, _, html in rows:
        data = (html or "").encode()
        other = first.get(data)
        again = other is not None and other != page
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", other if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, archive", [(2000, 256 << 20), (3, 2000)])
def test_pages_come_back(spark, monkeypatch, tmp_path, block, archive):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", block)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive)
    rows, frame = pages_frame(spark)
    clash = frame.selectExpr("*", "1 AS surt", "2 AS offset", "3 AS first_id").repartition(3)
    assert sorted(map(tuple, warc.archived_and_read(spark, clash).collect()), key=str) == plain_records(rows)


def test_archives_and_lookups(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "BLOCK_CAPTURES", 5)
    rows, frame = pages_frame(spark)
    folder, parts, tasks = warc.archive_pages(spark, frame, f"file://{tmp_path}/w")
    assert tasks == 1
    names = [f for f in os.listdir(tmp_path / "w") if f.endswith(".warc.gz")]
    whole = b"".join(gzip.decompress((tmp_path / "w" / f).read_bytes()) for f in names)
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    ids = re.findall(rb"WARC-Record-ID: <urn:uuid:([0-9a-f-]{36})>\r\n", whole)
    assert len(ids) == len(set(ids)) == len(re.findall(rb"WARC-Date: 20\d\d-\d\d-\d\dT[\d:]{8}Z\r\n", whole)) == len(rows)
    index = warc.CaptureIndex(folder, parts)
    found = index.captures("com,example,a)/3?q")
    want = {p for p, u, _ in rows if u == "https://A.example.com/3?q#f"}
    assert {c[1] for c in found} == want and want
    headers, body = index.record(next(c for c in index.captures("long)") if c[1] == 400))
    assert headers["WARC-Target-URI"] == "http://long" and warc.payload_of(body) == (3_000_000, b"z" * 3_000_000)
    assert index.captures("com,example,zz)/") == []
    capture = list(found[0])
    capture[4] -= 9
    with pytest.raises((EOFError, ValueError)):
        index.record(capture)


def test_no_pages(spark):
    assert warc.archived_and_read(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no", "http://", "http://X.COM", "http://com/", "ftp://a.com?q=/en/", "http://example.com/en/1", "http://WWW.example.com/en/#x",
            "http://a.www.example.com/en/", "http://wwwexample.com/en/", "http://n.net/es/a?b", "http://n.net/es", "://net/fr/", "x://a://b/c", "http://É.net/fr/ü"]
    want = [("", "", None), ("", "", None), ("", "", None), ("", "", None), ("x.com", "", None), ("com", "/", "com/"), ("a.com", "", None),
            ("example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("a.www.example.com", "/en/", "www.example.com/en/"),
            ("wwwexample.com", "/en/", "com/"), ("n.net", "/es/a", "net/es/"), ("n.net", "/es", None), ("net", "/fr/", "net/fr/"), ("a:", "//b/c", None),
            ("É.net", "/fr/ü", "net/fr/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS n", "2 AS good")
    none = spark.createDataFrame([], "page_id long, good int")
    got = url_reputation.judge_urls(pages, none, URL_RULES).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got] == want
    assert [r["verdict"] for r in got] == ["block" if r and r not in ("com/", "www.example.com/en/") else "allow" for *_, r in want]
    assert url_reputation.judge_urls(pages.limit(0), none, URL_RULES).count() == 0


def test_reputation_by_hand(spark):
    hosts = spark.createDataFrame([("a.x.org", 30, 0), ("b.x.org", 0, 0), ("c.y.org", 40, 40), ("w.z.co.uk", 3, 0), ("", 0, 0)], "host string, n long, good long")
    model = url_reputation.Reputation()
    got = {r["host"]: r for r in url_reputation.host_reputation(hosts, model).collect()}

    def shrink(prior, children, n, good):
        excess = max(0.0, sum((g - m * prior) ** 2 / (m * prior * (1 - prior)) - 1 for m, g in children if m))
        rho = min(max((excess + 1.0) / (sum(max(m - 1, 0) for m, _ in children) + 10.0), 0.001), 0.9)
        strength = 1 / rho - 1
        return (strength * prior + good) / (strength + n), strength + n

    org = 41.0 / 72.0
    x, _ = shrink(org, [(30, 0), (40, 40)], 30, 0)
    mean, weight = shrink(x, [(30, 0), (0, 0)], 30, 0)
    assert got["a.x.org"]["mean"] == pytest.approx(mean) and got["a.x.org"]["upper"] == pytest.approx(mean + 1.645 * (mean * (1 - mean) / (weight + 1)) ** 0.5)
    assert got["a.x.org"]["upper"] < 0.5 < got["c.y.org"]["mean"]
    # A host without labels stands between: its domain is bad, but it is not known well.
    assert got["a.x.org"]["mean"] < got["b.x.org"]["mean"] < 0.5
    assert got["w.z.co.uk"]["mean"] < 0.5 and got[""]["mean"] == pytest.approx(0.5)


def test_bad_host_is_blocked(spark):
    pages = spark.createDataFrame([(i, f"http://{'bad' if i < 50 else 'fine'}.org/{i}") for i in range(100)] + [(7, "http://bad.org/x")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i >= 50)) for i in range(0, 100, 2)] + [(52, None), (60, 1), (None, 0)], "page_id long, good int")
    got = url_reputation.judge_urls(pages, outcomes, URL_RULES).groupBy("host", "verdict").count().collect()
    assert {(r["host"], r["verdict"], r["count"]) for r in got} == {("bad.org", "block", 51), ("fine.org", "allow", 50)}
