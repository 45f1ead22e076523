import random

from weftgraph.llm import urlrules

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:at], rest[at:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain(pages, rules):
    out = []
    for i, url in pages:
        host, path = parse(url)
        fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        out.append((i, host, path, best[2] if best else None, best[3] if best else "allow"))
    return sorted(map(str, out))


def got(spark, pages, rules, **options):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in pages], "page_id long, url string, key string, part string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    return sorted(str(tuple(x)) for x in urlrules.judge(df, r, **options).collect())


ODD = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://COM"), (6, "http://a.com/"), (7, "http://www.Example.com/en/x?q#f"), (8, "https://m.example.com/en/"), (9, "http://example.com/en"), (10, "http://x.net?/es/"),
       (11, "http://x.net/es/"), (12, "http://net/fr/#a"), (13, "ftp://u@x.com:80/en/"), (14, "http://a,b.com/"), (15, "http://.com/"), (16, "http://a..com/"), (17, "http://xcom/"), (None, "http://b.com/z"), (7, "http://www.Example.com/en/x?q#f"), (18, "a://b://c.com/"), (19, "http://é.com/\n?x")]


def test_odd_pages(spark):
    assert got(spark, ODD, RULES) == plain(ODD, RULES)
    assert got(spark, [], RULES) == []
    assert got(spark, ODD, []) == plain(ODD, [])


def test_many_rules_and_a_hot_host(spark):
    r = random.Random(2)
    host = lambda n: ".".join(r.choice("abc") for _ in range(r.randint(1, n)))
    path = lambda: "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 3)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((host(4), path()) for _ in range(150))}.values())
    pages = [(i, f"http://{'a.b' if i % 3 == 0 else host(5)}{path()}") for i in range(900)] + [(5000 + i, "http://c.a/x") for i in range(300)]
    assert got(spark, pages, rules) == plain(pages, rules)


def test_default_and_repeated_rules(spark):
    assert got(spark, [(1, "http://a.org/")], RULES, default="block") == [str((1, "a.org", "/", None, "block"))]
    twice = [("a", "/", "block"), ("a", "/", "allow"), (None, "/", "block"), ("", "/", "block")]
    assert got(spark, [(1, "http://a/"), (2, "x")], twice) == sorted([str((1, "a", "/", "a/", "allow")), str((2, "", "", None, "allow"))])
