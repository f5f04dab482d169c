import random
import time

from assayspark.llm import url_filter as U


def brute(url, rules, sites):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:end], rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        host = host.translate({i: i + 32 for i in range(65, 91)})

    def best(rules):
        fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, default=None)

    rule, site = best(rules), best(sites)
    return host, path, rule and rule[2], rule[3] if rule else site[3] if site else "allow"


def check(spark, urls, rules=U.RULES, sites=U.SITES):
    got = U.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS rule", "2 AS host").repartition(3), rules, sites).collect()
    assert sorted(tuple(r) for r in got) == [(i, *brute(u, rules, sites)) for i, u in enumerate(urls)]


def test_cases(spark):
    check(spark, [None, "", "x", "http://", "http://com/en/", "HTTP://A.Example.COM/en/7?x=/en/8", "http://example.com/en/6#a", "http://xexample.net/de/8", "http://a.example.net/de/81", "http://é.org/es/é", "http://org?/es/", "a://spam-farm.example.org/", "http://spam-farm.example.com", "ftp://net/de/://com/en/"])


def test_random(spark):
    rnd = random.Random(2)
    hosts = ["a", "b.a", "c.b.a", "b", "x.b", "É.a"]
    rules = {(h, p): rnd.choice(["allow", "block"]) for h in hosts for p in ("/", "/a", "/a/b", "/é", "") if rnd.random() < 0.5}
    rules = [(a, h, p) for (h, p), a in rules.items()]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(['', 'a', 'a/b', 'é', 'a/bc'])}" for _ in range(150)]
    check(spark, urls, rules, [])


def test_many_arrays(spark, monkeypatch):
    monkeypatch.setattr(U, "ARRAY_RULES", 2)
    check(spark, ["http://a.example.net/de/8", "http://example.com/en/7", "http://x.net/de/", "http://q.org/es/"])


def test_rules_as_a_table_in_passes(spark, monkeypatch):
    """A table of rules, some of them twice or with both actions, gives what its rows give; passes leave no trace."""
    monkeypatch.setattr(U, "ARRAY_RULES", 3)
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "net", "/de/"), ("block", "b.example.net", ""), ("allow", "org", "/"), ("allow", "org", "/")]
    table = spark.createDataFrame([*rules, (None, "com", "/"), ("block", None, "/")], "action string, host string, path string")
    urls = ["http://x.com/en/1", "http://example.com/en/77", "http://q.net/de/1", "http://a.b.example.net/z", "http://w.org/", "http://w.org", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(map(tuple, U.judge_urls(pages, table, []).collect()))
    assert got == sorted(map(tuple, U.judge_urls(pages, rules, []).collect()))
    assert [(r, v) for *_, r, v in got] == [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "block"), ("b.example.net", "block"), ("org/", "allow"), (None, "allow"), (None, "allow")]


def test_long_urls_take_linear_time(spark):
    array = U.DigestArray([*U.RULES, ("block", "a.b.c.d", "/")])
    times = []
    for n in (4_000, 32_000):
        start = time.process_time()
        assert array.longest([(b"x." * n + b"example.com", b"/en/7" + b"y" * n)] * 5)[0][:2] == (b"example.com", b"/en/7")
        times.append(time.process_time() - start)
    assert times[1] < 16 * times[0] + 0.2
    check(spark, ["http://" + "x." * 50_000 + "example.com/en/" + "z" * 300_000, "http://" + "/" * 100_000 + "#" * 1000])


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_equal_digests_are_told_apart(monkeypatch):
    monkeypatch.setattr(U.DigestArray, "digest", staticmethod(lambda text: 7))
    array = U.DigestArray([("block", "a", "/"), ("allow", "b", "/")])
    assert array.find([b"b", b"c", b"a"], [b"/"] * 3).tolist()[1] == -1
    assert array.longest([(b"x.b", b"/q")])[0][2] == "allow"
