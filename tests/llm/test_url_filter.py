from __future__ import annotations

from demandspark.llm.url_filter import RULES, filter_urls

URLS = [None, "", "no scheme", "http://", "http://NET/", "https://a.Example.net/en/1?x=/en/", "http://example.net/de/", "http://example.net", "http://example.net?en/", "ftp://x.org/fr/#a", "http://x.org/fr", "http://notnet/", "http://b.example.com/de/9.html", "http://a://b.net/", "http://x.net/\n/y"]


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(c.lower() if c.isascii() else c for c in host), tail[:end]


def brute(url, rules):
    host, path = host_path(url)
    fit = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_against_brute_force(spark):
    more = [*RULES, ("example.com", "", "block"), ("b.example.com", "/d", "allow"), (None, "/", "block")]
    for rules in (RULES, more):
        pages = spark.createDataFrame([(i, u, "kept", "kept") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string, html string")
        got = filter_urls(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()
        assert len(got) == len(URLS) * 2
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, [x for x in rules if x[0]])
            assert r.html == "kept"


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in filter_urls(pages, rules).collect()] == ["allow"]
    assert filter_urls(pages.limit(0), rules).count() == 0


def test_hot_host_and_clashing_names(spark):
    urls = ["http://hot.example.net/en/x"] * 60 + [None, "no scheme"] * 20 + URLS
    columns = "page_id long, url string, _named string, _salt int, _asked_host string, _best string, Host string, verdict string"
    pages = spark.createDataFrame([(i % 50, u, "kept", 7, "kept", "kept", "gone", "gone") for i, u in enumerate(urls)], columns)
    got = filter_urls(pages, spark.createDataFrame(RULES, "host string, path string, action string"))
    assert got.columns == ["page_id", "url", "_named", "_salt", "_asked_host", "_best", "host", "path", "rule", "verdict"]
    rows = got.collect()
    assert sorted(str(r.url) for r in rows) == sorted(map(str, urls)) and all((r._named, r._salt, r._asked_host) == ("kept", 7, "kept") for r in rows)
    assert all((r.host, r.path, r.rule, r.verdict) == brute(r.url, RULES) for r in rows)
