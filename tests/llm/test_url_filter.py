import random

from tessera.llm.queries import QUERIES, URL_RULES, url_rules
from tessera.llm.url_filter import judge_urls

from tests.conftest import SF_SMALL

RULES = "action string, host string, path string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        ends = [rest.find(c) for c in "/?#" if c in rest]
        cut = min(ends, default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = max(fits, key=lambda r: r[:2])
    return host, path, best[2], best[3]


URLS = [None, "", "example.org/x", "http://", "http://Example.ORG", "http://example.org/", "https://a.b.example.org/es/1", "http://example.org/en/12?x",
        "http://example.org/en/?1", "http://xexample.org/es/", "http://org/", "ftp://a.com/fr/ü", "http://com/de/", "http://a.com/de/#", "a://b://c.org/x",
        "http://a..org/", "http://.com/fr/", "http://a.com./fr/", "http://a.com:80/fr/", "http://u@a.com/fr/", "HTTP://A.COM/FR/", "http://a.com/fr/\n?", "http://" + "a." * 3000 + "com/fr/" + "y" * 5000]


def rows(spark, urls):
    return spark.createDataFrame([(i, u, "clash", "h") for i, u in enumerate(urls)] + [(None, urls[5], "c", "h"), (5, urls[5], "c", "h")], "page_id long, url string, host string, rule string")


def test_same_as_brute_force(spark):
    r = random.Random(3)
    urls = URLS + [f"http://{r.choice(['', 'a.', 'b.a.'])}{r.choice(['example', 'x'])}.{r.choice(['org', 'com', 'net'])}/{r.choice(['en', 'es', 'fr', 'de'])}/{r.randrange(30)}" for _ in range(200)]
    for sweeps in (1, 5):
        got = judge_urls(rows(spark, urls), spark.createDataFrame(URL_RULES, RULES), sweeps=sweeps).collect()
        assert len(got) == len(urls) + 2
        for g in got:
            assert (g.host, g.path, g.rule, g.verdict) == brute(g.url, URL_RULES)


def test_nested_rules(spark):
    rules = [("allow", "a.com", "/"), ("block", "a.com", "/x/"), ("allow", "a.com", "/x/y/z"), ("block", "b.a.com", "/x/"), ("block", "com", ""), ("allow", "a.com", "/x/y")]
    urls = ["http://a.com/x/y/zz", "http://a.com/x/yz", "http://a.com/x/z", "http://b.a.com/x/z", "http://b.a.com/x/y/z", "http://c.com", "http://a.com/", "http://a.net/"]
    for g in judge_urls(rows(spark, urls), spark.createDataFrame(rules, RULES)).collect():
        assert (g.rule, g.verdict) == brute(g.url, rules)[2:]


def test_empty(spark):
    rules = spark.createDataFrame(URL_RULES, RULES)
    assert judge_urls(rows(spark, URLS).limit(0), rules).collect() == []
    assert {g.rule for g in judge_urls(rows(spark, URLS), rules.limit(0), default="block").collect()} == {None}


def test_no_python_on_the_main_path(spark):
    plan = judge_urls(rows(spark, URLS), spark.createDataFrame(URL_RULES, RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_python_reads_the_rules(spark):
    assert [tuple(r) for r in url_rules(spark).collect()] == URL_RULES
    query = QUERIES["op7_url_filter"](spark, SF_SMALL)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "Python" not in plan and "Arrow" not in plan
    assert "Python" not in query._jdf.queryExecution().toRdd().toDebugString()
