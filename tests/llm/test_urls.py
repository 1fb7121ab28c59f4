import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusqa.llm import urls

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, rest = rest[:end].translate(UPPER), rest[end:]
    return host, rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]


def plain(url, rules, default="allow"):
    host, path = split(url)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, default)


URLS = [
    None, "", "no scheme", "http://", "https://ORG/", "https://org", "http://a.Example.ORG/en/1x?q#f", "http://example.org/en/2", "http://example.org/es", "http://example.org/es/",
    "http://notexample.org/es/1", "http://x.com/fr/", "http://com/de/#", "ftp://x.com?/de/", "http://a://b.org/en/1", "http://u:p@x.org:80/", "http://.org/", "http://org./", "http://x..org//",
    "http://É.org/é\U0001f600/", "x://\n.org/\n", "HTTP://WWW.EXAMPLE.ORG/EN/1", "http://" + "a." * 3000 + "org/" + "b" * 5000,
]


def judged(spark, given_urls, rules, **kw):
    pages = spark.createDataFrame([(i, u, "clash", "x") for i, u in enumerate(given_urls)], "page_id long, url string, host string, e_host string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, table, **kw).collect()}


def test_stated_rules(spark):
    wanted = {i: plain(u, urls.RULES) for i, u in enumerate(URLS)}
    assert judged(spark, URLS, list(urls.RULES)) == wanted
    assert judged(spark, URLS, list(urls.RULES), sent=0, default="block") == {i: plain(u, urls.RULES, "block") for i, u in enumerate(URLS)}


def test_many_rules_ties_and_bad_rules(spark):
    r = random.Random(4)
    hosts = ["a.b", "b", "x.a.b", "c.b", "c"]
    paths = ["", "/", "/p", "/p/q", "/é", "/p/q/r"]
    rules = [(r.choice(hosts), r.choice(paths), r.choice(["allow", "block"])) for _ in range(40)]
    given_urls = [f"http://{r.choice(['', 'w.', 'x.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', 'z', '/', '?a'])}" for _ in range(300)]
    bad = [("b", None, "block"), (None, "/", "block"), ("b", "/", None), ("b", "/", "maybe"), ("", "/", "block")]
    assert judged(spark, given_urls, rules + rules[:5] + bad) == {i: plain(u, rules) for i, u in enumerate(given_urls)}


def test_empty_and_repeated(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/"), (None, None), (None, "http://a.org/")], "page_id long, url string")
    rules = urls.stated_rules(spark)
    found = sorted(map(repr, urls.judge_urls(pages, rules).collect()))
    assert len(found) == 4 and sum("'org/'" in f for f in found) == 3
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="a.:/?#Z", max_size=20))
def test_plain_split_agrees_with_itself(url):
    host, path = split(url)
    assert "/" not in host and not set("?#") & set(path)
