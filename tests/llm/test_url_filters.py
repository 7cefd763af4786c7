import math
import random

import pyarrow as pa
import pytest

from pingpath.llm import url_filters
from pingpath.llm.url_filters import RULES

PAGES = "page_id long, url string, html string, host string, given string, features string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "x", "x", "x") for i, u in enumerate(urls)], PAGES)


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, rule in RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


ODD = [None, "", "no scheme.org/", "://", "http://", "HTTP://A.ORG/x?y=1#z", "http://example.org/en/1", "http://x.example.org/en/12/3",
       "http://example.org/es/", "http://example.org/es", "http://notexample.org/es/a", "http://org/", "http://org", "http://b.com/fr/?q",
       "http://b.com/de/", "http://com/fr/x", "http://a.net/en/1://b", "http://É.org/É", "http://a.org?x=/", "http://a.org#/", "http://" + "a" * 50_000 + ".net/" + "9" * 50_000,
       "http://a.net/b\nc?d", "http://b.com/de/", "http://b.com/de/"]


def test_parts_and_rules(spark):
    got = {r["page_id"]: r for r in url_filters.judge(pages(spark, ODD)).collect()}
    assert len(got) == len(ODD)
    for i, url in enumerate(ODD):
        host, path, rule = brute(url)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule[1]), url
        assert got[i]["verdict"] in ("allow", "block") and (rule is None or got[i]["verdict"] == rule[0])


def test_empty_and_unlabelled(spark):
    assert url_filters.judge(pages(spark, [])).count() == 0
    assert {r["verdict"] for r in url_filters.judge(pages(spark, ["http://a.net/", None])).collect()} == {"allow"}
    assert {r["verdict"] for r in url_filters.judge(pages(spark, ["http://a.net/", "http://b.com/de/"])).collect()} == {"block"}


def test_lexical_features():
    x = url_filters._byte_features(pa.array(["http://a-b.net/x/y?k=1&l=22#t", None, "aab"]))
    assert x[0][0] == 29 and x[0][1] == 2 and x[0][2] == pytest.approx(3 / 29) and x[0][5:11].tolist() == [2, 1, 1, 1, 1, 1]
    assert not x[1].any() and x[2][4] == pytest.approx(-(2 / 3 * math.log2(2 / 3) + 1 / 3 * math.log2(1 / 3)))


def test_trees_learn_from_labelled_urls(spark):
    """Blocked urls are long and full of digits; unlabelled ones of that kind are blocked."""
    rng = random.Random(1)
    bad = lambda host, p: f"http://{host}{p}{rng.randrange(10**12)}?a={rng.randrange(10**9)}&b={rng.randrange(10**9)}"
    good = lambda host, p: f"http://{host}{p}{''.join(rng.choice('abcdef') for _ in range(6))}"
    urls = [bad("s.com", "/de/") for _ in range(300)] + [good("s.com", "/fr/") for _ in range(300)]
    urls += [bad("s.com", "/en/") for _ in range(100)] + [good("s.com", "/en/") for _ in range(100)]
    got = {r["page_id"]: r for r in url_filters.judge(pages(spark, urls)).collect()}
    right = sum(got[i]["verdict"] == ("block" if i < 700 else "allow") for i in range(600, 800))
    assert right >= 195 and all(got[i]["rule"] is None for i in range(600, 800))
