"""The sweep against a brute-force judgement of every rule for every url."""

import random

import pytest

pytest.importorskip("fiscalis.llm")

from fiscalis.llm import url_filters  # noqa: E402


def brute(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best[3] if best else None, best[4] if best else default)


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "", "allow"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.example.org", "/", "block"), ("a.example.org", "/", "allow"),
         ("com", None, "block"), ("b.com", "/d", "allow")]


@pytest.mark.parametrize("rows_a_range", [5, 50_000])
def test_against_brute_force(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(url_filters, "ROWS_A_RANGE", rows_a_range)
    rng = random.Random(3)
    urls = [None, "", "no scheme", "http://", "://", "HTTP://EXAMPLE.org/en/1", "https://xexample.org/es/", "http://x.com/de/a://b.org/",
            "http://org", "http://org?x=/es/", "http://example.org.", "http://..org/", "http://ÄB.example.org/es/\n?"]
    for _ in range(300):
        host = ".".join(rng.choices(["a", "b", "example", "org", "com", "A"], k=rng.randint(1, 4)))
        urls.append(f"http://{host}{rng.choice(['/', '/es/', '/en/1', '/de/x', '/d', '', '/fr/' + 'y' * 50])}{rng.choice(['', '?q', '#f'])}")
    urls += ["http://hot.example.org/en/1"] * 150
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    df = df.selectExpr("*", "'x' AS host", "1 AS path", "2 AS part", "3 AS rule")  # columns whose names clash
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_urls(df, rules).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_empty_tables(spark):
    urls = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filters.judge_urls(urls, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in url_filters.judge_urls(one, rules).collect()) == [(0, "allow"), (1, "allow"), (1, "allow")]
