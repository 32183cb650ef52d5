import random

import pytest

from canopyflow.llm import urlfilter
from canopyflow.llm.queries import RULES
from canopyflow.llm.urlfilter import Rule, judge_urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, _, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[len(host):]


def brute(url, rules):
    host, path = parts(url)
    fits = [r for r in rules for h, p in [r[0].split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    best = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
    return host, path, *best


def urls(n):
    rnd = random.Random(5)
    bits = ["net", "example.", "EXAMPLE.", "com", "/", "/de/", "/en/", "org/fr/", ".", "?q=1", "#a", "://", "x", "é", "a.net/", "ÀB"]
    return [None, "", "http://", "http:///net/"] + ["http://" + "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8))) for _ in range(n)] + ["https://" + "a" * 70_000 + ".net/x"]


@pytest.mark.parametrize("states", [4096, 12])
def test_rules(spark, monkeypatch, states):
    monkeypatch.setattr(urlfilter, "_STATES", states)
    given = urls(800)
    pages = spark.createDataFrame([(i if i % 7 else None, u, "x", "y") for i, u in enumerate(given)], "page_id long, url string, host string, path string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, [Rule(*r) for r in RULES]).collect()]
    assert sorted(map(repr, got)) == sorted(repr(brute(u, RULES)) for u in given)
    assert judge_urls(pages.limit(0), [Rule(*r) for r in RULES]).count() == 0


def test_wildcards(spark):
    rules = [Rule("ex*le.com/d?/*x", "block"), Rule("*.org/", "block"), Rule("com/", "allow")]
    pages = spark.createDataFrame([(0, "http://exle.com/da/x"), (1, "http://a.ex.le.com/d1/22x3"), (2, "http://ex/le.com/de/x"), (3, "http://example.com/d/x"), (4, "http://b.org/"), (5, "http://org/")], "page_id long, url string")
    got = {r.page_id: r.rule for r in judge_urls(pages, rules).collect()}
    assert got == {0: rules[0].text, 1: rules[0].text, 2: None, 3: "com/", 4: "*.org/", 5: None}


def test_a_rule_needs_one_verdict(spark):
    with pytest.raises(ValueError):
        judge_urls(spark.createDataFrame([(1, "")], "page_id long, url string"), [Rule("a/", "allow"), Rule("a/", "block")])
