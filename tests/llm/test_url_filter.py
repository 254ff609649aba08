import itertools
import random

from souk.llm import queries, url_filter


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[:next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [None, "", "net/", "http://net", "http://net/", "HTTP://A.NET/x", "http://example.net/en/1?q#f", "http://x.example.net/en",
        "http://notexample.net/en/", "http://example.com/de/", "http://EXAMPLE.com:80/de/", "http://a.b.org/fr/\nx", "http://org/fr/",
        "http://net/http://example.com/de/", "://net/a", "http://É.net/é", "http://net?x/", "a://" + "l." * 2000 + "net/" + "p/" * 5000,
        "http:///net/", "http://.net/", "http://net./x"]


def table(spark, urls):
    return spark.createDataFrame([(i, u, "<p>", "own", "own") for i, u in enumerate(urls)],
                                 "page_id long, url string, html string, host string, rule string")


def test_query_against_brute_force(spark, sf):
    urls = URLS + URLS[:3]
    got = queries.op6_url_bloom_cascade(spark, sf(pages=table(spark, urls))).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(i, *brute(u, queries.URL_RULES)) for i, u in enumerate(urls)]


def test_many_rules_need_several_levels(spark):
    r = random.Random(7)
    hosts = [".".join(x) for x in itertools.product("abcdef", "xyz", ["com", "net"])]
    rules = [(h, r.choice(["/", "/p", "/p/q/", ""]), r.choice(["allow", "block"])) for h in hosts if r.random() < 0.4]
    rules = [(h, p, v) for (h, p), v in {(h, p): v for h, p, v in rules}.items()]
    urls = [f"http://{r.choice(['', 'w.'])}{r.choice(hosts)}{r.choice(['/', '/p', '/p/q/r', '', '/z'])}" for _ in range(400)]
    got = url_filter.filter_urls(spark, table(spark, urls), rules).orderBy("page_id").collect()
    assert [tuple(x) for x in got] == [(i, *brute(u, rules)) for i, u in enumerate(urls)]


def test_no_rules_and_no_rows(spark, sf):
    assert url_filter.filter_urls(spark, table(spark, URLS[:4]), [], default="block").select("verdict").distinct().collect()[0][0] == "block"
    assert queries.op6_url_bloom_cascade(spark, sf(pages=table(spark, []))).count() == 0
