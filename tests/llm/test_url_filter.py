import random

from opinionloom.llm import url_filter
from opinionloom.llm.url_filter import judge_urls

RULES = "host string, path string, verdict string"


def by_hand(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in rules if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    out = judge_urls(pages, spark.createDataFrame(rules, RULES)).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}


def test_against_brute_force(spark, monkeypatch):
    pick = random.Random(1)
    names, parts = ["a", "b", "com", "x"], ["", "/", "/p", "/p/", "/p/q", "/pq/r/"]
    host = lambda: ".".join(pick.choices(names, k=pick.randint(1, 4)))
    rules = {(host(), pick.choice(parts)): pick.choice(["allow", "block"]) for _ in range(25)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{host().upper()}{pick.choice(parts)}{pick.choice(['', 'z', '?q=/p/', '#/p/'])}" for _ in range(200)]
    urls += [None, "", "nothing", "://", "x://a.com", "http://a.b.com/p/\n/q", "http://" + ".".join("a" * 300) + "/p" * 3000]
    want = {i: by_hand(u, rules) for i, u in enumerate(urls)}
    assert judged(spark, urls, rules) == want
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", -1)
    assert judged(spark, urls, rules) == want


def test_nulls_repeats_and_empty_tables(spark):
    rules = [("com", "/", "block"), ("com", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("com", None, "block")]
    assert judged(spark, ["http://a.com/x", None], rules) == {0: ("a.com", "/x", "com/", "allow"), 1: ("", "", None, "allow")}
    assert judged(spark, ["http://a.com/x"], []) == {0: ("a.com", "/x", None, "allow")}
    assert judged(spark, [], rules) == {}
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, "http://a.com/")], "page_id long, url string")
    assert judge_urls(pages, spark.createDataFrame(rules, RULES)).count() == 3


def test_longest_rule_wins_whatever_its_verdict(spark):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")]
    urls = ["http://example.com/en/1", "http://www.example.com/en/1", "http://notexample.com/en/1", "http://m.example.com/en"]
    assert [v[3] for _, v in sorted(judged(spark, urls, rules).items())] == ["block", "allow", "allow", "allow"]
