import re

from marginalia.llm.url_rules import HOST_RULES, PATTERN_RULES, Rule, judge_urls, regex, tokens_of_pattern

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "https://A.Example.NET/en/x?q=/de/", "https://example.net/en", "x://y://net/",
    "https://EXAMPLE.com/de/1#f", "https://www.example.com/de/1", "https://notexample.com/de/1", "https://fr.example.org/fr/", "http://org/fr/?a",
    "https://spam-farm.example.org/en/", "https://www.spam-farm.example.org/fr/1", "https://ads.example.org/", "https://bads.example.org/",
    "https://a.org/login/", "https://a.org/Login/", "https://a.org/downloads/x/y.zip", "https://a.org/downloads/x.zipper", "https://é.net/ü",
] * 2


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fitting = [r for r in rules if re.search(regex(r.pattern), host + path)]
    best = max(fitting, key=lambda r: (r.rank, r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i if i % 5 else None, u, "r", "h") for i, u in enumerate(URLS)], "page_id long, url string, row string, host string")
    free = Rule("free", "oads*zip", "block", 5)
    for rules in (HOST_RULES + PATTERN_RULES, HOST_RULES + PATTERN_RULES + (free,)):
        got = judge_urls(pages, rules)
        assert set(got.columns) == {"page_id", "url", "row", "host", "path", "rule", "verdict"}
        rows = sorted(map(str, ((r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect())))
        assert rows == sorted(map(str, ((u, *brute(u, rules)) for u in URLS)))
    assert judge_urls(pages.limit(0)).count() == 0


def test_contract_rules_by_hand(spark):
    expected = {
        "http://net": None, "http://net/": "net/", "https://a.example.net/en/x": "example.net/en/", "https://example.net/fr/": "net/",
        "https://example.com/de/": "example.com/de/", "https://notexample.com/de/": None, "https://x.org/fr/": "org/fr/", "https://x.org/fr": None,
    }
    pages = spark.createDataFrame([(u,) for u in expected], "url string")
    assert {r["url"]: r["rule"] for r in judge_urls(pages).collect()} == expected


def test_tokens_are_bounded():
    assert tokens_of_pattern("||example.net/en/") == ["example", "net", "en"]
    assert tokens_of_pattern("spam-farm.") == ["farm"]
    assert tokens_of_pattern("/downloads/*.zip") == ["downloads"]
    assert tokens_of_pattern("oads*zip") == []
