from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gaugelab.llm import url_filter

PAGES = "page_id long, url string"


def brute(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, otherwise
    best = max(fits)
    return host, path, best[3], best[2]


def judged(spark, urls, rules=url_filter.RULES, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), PAGES)
    found = url_filter.judge(pages, url_filter.rule_table(spark, rules) if rules else spark.createDataFrame([], "host string, path string, verdict string"), **more)
    return {r["page_id"]: tuple(r)[1:] for r in found.collect()}


CASES = [
    None, "", "example.net/en/", "http://example.net", "http://example.net/", "http://EXAMPLE.net/en/1", "http://a.b.example.net/en", "http://net/x?y#z",
    "http://x.net?/en/", "http://badexample.net/en/a", "http://example.com/de/1", "http://example.com/DE/1", "https://m.example.com/de/", "http://sub.org/fr/9#t",
    "http://org/fr/", "http://org/fr", "ftp://.net/", "http://a..net/", "://net/", "http:////net/", "http://u@example.net:80/en/", "http://first.net://second.org/fr/",
    "http://line\nbreak.net/en/\n", "http://Ünet/", "http://x.Énet/", "http://net./", "http://x.net/é/" + "p" * 200_000, "http://" + "a." * 50_000 + "org/fr/", "//", "http://?x", "http://#",
]


def test_cases(spark):
    assert judged(spark, CASES) == {i: brute(u, url_filter.RULES) for i, u in enumerate(CASES)}


def test_random_rules(spark):
    draw = random.Random(5)
    label = lambda: draw.choice(["a", "b", "net", "org", "x-y"])
    host = lambda n: ".".join(label() for _ in range(n))
    path = lambda: draw.choice(["", "/", "/a", "/a/", "/a/b", "/b/", "/ab"])
    rules = list({(h, p): (h, p, draw.choice(["allow", "block"])) for h, p in ((host(draw.randint(1, 3)), path()) for _ in range(60))}.values())
    urls = [f"http://{host(draw.randint(1, 4))}{path()}{draw.choice(['', '?q', '#f', '/c'])}" for _ in range(600)]
    assert judged(spark, urls, rules, otherwise="block") == {i: brute(u, rules, "block") for i, u in enumerate(urls)}


def test_false_positives_of_a_full_filter_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BLOCKS", 1)
    rules = [(f"h{i}.net", f"/{i}/", "block") for i in range(500)]
    urls = [f"http://www.h{i}.net/{i % 700}/x" for i in range(1000)]
    found = judged(spark, urls, rules)
    assert found == {i: brute(u, rules) for i, u in enumerate(urls)}
    assert sum(v[3] == "block" for v in found.values()) == 500


def test_filter_holds_every_key_and_few_others(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    blocks = url_filter.block_count(20_000)
    bits = url_filter.bloom_blocks(keys, blocks)
    assert url_filter.possible(keys, bits, blocks).count() == 20_000
    others = spark.range(20_000).select(F.concat(F.lit("o"), "id").alias("key"))
    assert url_filter.possible(others, bits, blocks).count() < 600


@pytest.mark.parametrize("rules", [[], [(None, "/", "block"), ("", "/", "block")]])
def test_no_rules(spark, rules):
    assert judged(spark, ["http://x.net/"], rules) == {0: ("x.net", "/", None, "allow")}


def test_rules_said_twice_and_without_path(spark):
    assert judged(spark, ["http://x.net/", "http://net"], [("net", "/", "allow"), ("NET", "/", "block"), ("net", None, "allow")]) == {0: ("x.net", "/", "net/", "block"), 1: ("net", "", "net", "allow")}


def test_repeated_rows_clashing_names_and_empty_tables(spark):
    rows = [(None, "http://x.net/", "h", "r", 1)] * 3 + [(1, "http://x.org/", None, None, 2)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, row int")
    found = sorted(tuple(r) for r in url_filter.judge(pages, url_filter.rule_table(spark)).fillna(-1, "page_id").fillna("-").collect())
    assert found == [(-1, "x.net", "/", "net/", "block")] * 3 + [(1, "x.org", "/", "-", "allow")] * 2
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
