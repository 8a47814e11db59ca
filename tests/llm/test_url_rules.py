"""URL rules against the plain test of every rule on every url."""

import random

import pytest

from occupipe.llm import url_rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def brute(url, rules, otherwise="allow"):
    host, path = parse(url)
    fits = [r for r in rules if r[0] and r[1] is not None and r[2] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    if not fits:
        return host, path, None, otherwise
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2], r[0] + r[1]))
    return host, path, best[0] + best[1], best[2]


def frames(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    return pages, spark.createDataFrame(rules, "host string, path string, verdict string")


AWKWARD = [
    None, "", "example.net/en/", "http://", "http://net", "http://net/", "http://NET/x", "http://a.b.Example.NET/en/x?y#z", "http://example.net/en",
    "http://example.net?x=/en/", "http://notexample.net/en/", "http://example.com/de/", "http://Example.com./de/", "http://x.org/fr/#a?b",
    "http://x.org/fr?/", "http://example.com:80/de/", "ftp://u@example.com/de/a://b", "http://.net/", "http://..net//", "http://ex\nample.net/en/\n/x",
    "http://ÄÖ.net/ü", "http://" + "a." * 30_000 + "example.net/en/" + "x/" * 30_000, "http://example.net/" + "en/" * 5,
]


def test_awkward_urls(spark):
    pages, rules = frames(spark, AWKWARD + AWKWARD[3:8], RULES)
    got = url_rules.judge(pages, rules).collect()
    assert [c for c in got[0].asDict()] == ["page_id", "url", "host", "path", "rule", "verdict"]
    want = {i: brute(u, RULES) for i, u in enumerate(AWKWARD + AWKWARD[3:8])}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("sent", [0, 1000])
def test_random_rules(spark, sent):
    """Paths that end between slashes, ties, nulls and rules stated twice, broadcast and shuffled."""
    draw = random.Random(5)
    hosts = ["a", "b.a", "c.b.a", "d.a", "A.a", "aa"]
    paths = ["", "/", "/x", "/x/", "/xy", "/x/y", "/x/y/", "x"]
    rules = [(draw.choice(hosts), draw.choice(paths), draw.choice(["block", "allow"])) for _ in range(12)]
    rules += rules[:3] + [(None, "/", "block"), ("", "/", "block"), ("a", None, "block"), ("a", "/", None)]
    once = {}
    for h, p, v in rules:
        if h and p is not None and v:
            once[h.lower(), p] = max(v, once.get((h.lower(), p), ""))
    rules_once = [(h, p, v) for (h, p), v in once.items()]
    urls = [f"http://{draw.choice(['', 'z.', 'y.z.'])}{draw.choice(hosts)}{draw.choice(paths[:-1])}{draw.choice(['', 'q', '/q', '?q', '#q'])}" for _ in range(300)]
    pages, table = frames(spark, urls, rules)
    got = url_rules.judge(pages.repartition(4), table, otherwise="none", rules_sent=sent).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: brute(u, rules_once, "none") for i, u in enumerate(urls)}


def test_empty_tables(spark):
    pages, rules = frames(spark, ["http://net/"], RULES)
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    alone = url_rules.judge(pages, rules.limit(0)).first()
    assert (alone.host, alone.path, alone.rule, alone.verdict) == ("net", "/", None, "allow")


def test_no_python_on_the_path(spark):
    pages, rules = frames(spark, AWKWARD, RULES)
    plan = url_rules.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
