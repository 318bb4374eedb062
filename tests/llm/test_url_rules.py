"""Urls against a rule-by-rule check."""

import random

import pytest
from cases import collected

from buildscope.llm import url_rules
from buildscope.llm.workload import URL_RULES


def plain(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, verdict, rule = max(fits, default=(0, 0, "allow", None))
    return host, path, rule, verdict


ODD = [None, "", "no scheme", "http://", "http://org", "http://ORG/", "x://a.b.example.ORG/es/1?q#f", "http://example.org/en/1", "http://example.org/en/2",
       "http://notexample.org/es/", "http://com/fr/", "http://fr.com/fr", "https://com.org/de/", "http://a..org/", "http://.org/x", "http://org./", "p://é.org/ü?://",
       "http://a.com#/fr/", "http://a.com?/fr/", "a://b://c.org/"]


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    assert collected(url_rules.judge_urls(pages, table)) == sorted(((i, *plain(u, rules)) for i, u in enumerate(urls)), key=repr)


def test_odd_urls(spark):
    check(spark, ODD, URL_RULES)


def test_many_nested_rules_over_many_ranges(spark):
    draw = random.Random(4)
    host = lambda: ".".join(draw.choice(["a", "b", "ab", "c"]) for _ in range(draw.randint(1, 4)))
    path = lambda: "/" + "/".join(draw.choice(["x", "y", "xy"]) for _ in range(draw.randint(0, 3)))
    rules = list({(host(), path()): draw.choice(["allow", "block"]) for _ in range(120)}.items())
    check(spark, ["s://" + host() + path() for _ in range(600)] + ["s://a.b/x/y"] * 300, [(h, p, v) for (h, p), v in rules])


def test_equal_rules_null_rules_and_empty_tables(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("org", "/", "block"), (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "s://x.org/"), (None, "s://x.org/")], "page_id long, url string")
    assert {r.verdict for r in url_rules.judge_urls(pages, rules).collect()} == {"block"}
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert [r.rule for r in url_rules.judge_urls(pages, rules.limit(0)).collect()] == [None, None]


@pytest.mark.parametrize("kind, ids", [("long", [2**53 + 1, 2**53 + 3, None, -5, 2**63 - 1]), ("string", ["b", None, "a", "", "é"]), ("int", [1, 2, None, 4, 5])])
def test_ids_of_any_type_stay_as_they_are(spark, kind, ids):
    pages = spark.createDataFrame([(key, f"http://a{i}.org/x") for i, key in enumerate(ids)], f"page_id {kind}, url string")
    rules = spark.createDataFrame([("org", "/", "block")], "host string, path string, verdict string")
    found = url_rules.judge_urls(pages, rules)
    assert found.schema["page_id"].dataType.simpleString() == pages.schema["page_id"].dataType.simpleString()
    assert {(r.page_id, r.host, r.verdict) for r in found.collect()} == {(key, f"a{i}.org", "block") for i, key in enumerate(ids)}
