import random

import pytest

from sourceloom.llm import urls
from sourceloom.llm.queries import URL_RULES

RULES = [*URL_RULES, ("a.net/en/x", "block"), ("b.c/", "block"), ("b.c/", "allow"), ("no slash", "block"), (None, "block"), ("q.r/", None)]


def verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    known = {}
    for rule, v in rules:
        if rule and "/" in rule and v:
            known[rule] = max(v, known.get(rule, ""))
    best = None
    for rule in known:
        h, p = rule.split("/", 1)
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or (), (len(rule), len(h), rule))
    return host, path, best and best[2], known[best[2]] if best else "allow"


@pytest.mark.parametrize("shard", [1_000_000, 2])
def test_like_plain_rules(spark, monkeypatch, shard):
    monkeypatch.setattr(urls, "SHARD_KEYS", shard)
    rng = random.Random(1)
    hosts = ["net", "a.net", "EXAMPLE.net", "www.example.net", "xexample.net", "example.com", "m.example.com", "x.org", "org", "b.c", "d.b.c", "net.x", ""]
    rows = [None, "", "no scheme", "https://", "x://net", "x://net?/", "x://net/#a://b/", "http://a.net/en/xyz", "y" * 50_000, "x://" + "l." * 200 + "net/" + "p" * 9_000]
    rows += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x', '/de/1', '/fr/', '/en', '?q', '#/en/'])}" for _ in range(300)]
    pages = spark.createDataFrame([(k % 300, u, "h", "k") for k, u in enumerate(rows)], "page_id bigint, url string, host string, keys string")
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()), key=repr)
    assert got == sorted([(k % 300, *verdict(u, RULES)) for k, u in enumerate(rows)], key=repr)


def test_no_rules_no_pages(spark):
    pages = spark.createDataFrame([(1, "x://a/")], "page_id bigint, url string")
    none = spark.createDataFrame([], "rule string, verdict string")
    assert [(r.rule, r.verdict) for r in urls.judge(pages, none).collect()] == [(None, "allow")]
    assert urls.judge(pages.limit(0), none).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(3_000).selectExpr("xxhash64(id) as a", "xxhash64(1, id) as b", "id % 7 = 0 as listed")
    made = urls.cascade(keys.where("listed").drop("listed"), keys.drop("listed"))
    rows = keys.toPandas()
    assert len(made.levels) > 1
    assert (made.has(urls.numbers(rows.a), urls.numbers(rows.b)) == rows.listed).all()
