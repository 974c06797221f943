from __future__ import annotations

from sievecraft.llm import url_filter as u
from sievecraft.llm.queries import URL_RULES


def page(k, url, html=""):
    return (k, url, html, "x")


def run(spark, rows, rules=URL_RULES, links=None):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    edges = None if links is None else spark.createDataFrame(links, "src string, dst string")
    return {r["page_id"]: r for r in u.filter_urls(pages, rules, edges).collect()}


def test_rules_longest_wins(spark):
    got = run(
        spark,
        [
            page(1, "http://WWW.Example.com/en/1?x#y"),
            page(2, "https://m.example.com/en/1"),
            page(3, "http://example.com/de/1"),
            page(4, "http://a.net/es/2"),
            page(5, "http://notexample.org/en/"),
            page(6, "http://com"),
            page(7, "nothing"),
            page(8, None),
            page(9, "http://x.com?y=/z"),
        ],
    )
    assert {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in got.items()} == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        2: ("m.example.com", "/en/1", "example.com/en/", "block"),
        3: ("example.com", "/de/1", "com/", "allow"),
        4: ("a.net", "/es/2", "net/es/", "block"),
        5: ("notexample.org", "/en/", None, "allow"),
        6: ("com", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("x.com", "", None, "allow"),
    }


def test_blocks_spread_and_allow_has_precedence(spark):
    rules = [u.Rule("bad.org", "/", "block"), u.Rule("good.org", "/", "allow")]
    rows = [page(1, "http://bad.org/a"), page(2, "http://x.org/1#f"), page(3, "http://y.org/"), page(4, "http://good.org/z"), page(5, "http://w.org/2"), page(6, "http://bad.org/b"), page(7, "http://lone.org/")]
    links = [("http://x.org/1", "http://BAD.org/a"), ("http://y.org", "http://x.org/1"), ("http://w.org/2", "http://good.org/z"), ("http://bad.org/b", "http://w.org/2"), (None, "http://lone.org/"), ("http://lone.org/", "http://lone.org/#me")]
    got = run(spark, rows, rules, links)
    assert {k: r["verdict"] for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow"}
    assert got[2]["class_id"] == got[3]["class_id"] is not None and got[7]["class_id"] is None


def test_links_of_pages(spark):
    html = "<!-- <link rel=canonical href='/no'> --><LINK href='../up?a=1&amp;b=2' rel='x canonical'><meta http-equiv=Refresh content=\"5; URL='http://bad.org/t'\"><script>'<link rel=canonical href=/no>'</script>"
    assert u.link_targets("http://x.org/d/e/f", html) == ["http://x.org/d/up?a=1&b=2", "http://bad.org/t"]
    assert u.link_targets(None, None) == [] and u.link_targets("http://x.org/", "<link rel=canonical href='http://[bad'>") == []
    rules = [u.Rule("bad.org", "/", "block")]
    got = run(spark, [page(1, "http://x.org/d/e/f", html), page(2, "http://z.org/", None)], rules)
    assert (got[1]["verdict"], got[2]["verdict"]) == ("block", "allow")


def test_rule_table_agrees_with_inline_rules(spark):
    rows = [page(k, f"http://{h}{p}") for k, (h, p) in enumerate((h, p) for h in ("example.com", "www.example.com", "a.net", "b.a.net", "org") for p in ("", "/", "/en/x", "/es/", "/fr/y"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    own = pages.select("page_id", u.host_of(pages.url).alias("host"), u.path_of(pages.url).alias("path"))
    table = spark.createDataFrame(list(URL_RULES), "rule_host string, rule_path string, rule_verdict string")
    columns = ("page_id", "rule", "rule_verdict")
    assert sorted(map(str, u.match_rules(own, URL_RULES).select(*columns).collect())) == sorted(map(str, u.match_rule_table(own, table).select(*columns).collect()))
    many = [*URL_RULES, *(u.Rule(f"h{k}.org", "/", "block") for k in range(u.INLINE_RULES))]
    assert u.match_rules(own, many).where("rule is not null").count() == u.match_rules(own, URL_RULES).where("rule is not null").count()


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_ties_go_to_the_first_name_on_both_paths(spark):
    pair = [u.Rule("a.com", "/bx", "block"), u.Rule("com", "/bxyz", "allow")]
    many = pair + [u.Rule(f"h{k}.org", "/", "block") for k in range(u.INLINE_RULES)]
    for rules in (pair, many, pair[::-1], many[::-1]):
        got = run(spark, [page(1, "http://a.com/bxyz")], rules)[1]
        assert (got["rule"], got["verdict"]) == ("a.com/bx", "block")


def test_hostile_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for unit in ("<!--", "<script>", "<link ", "<link rel=", "<meta a='", "x", "<script></script   ", "<link " + "a" * 50_000 + ">", '<link rel="'):
        u.link_targets("http://x.org/", unit * (600_000 // len(unit)))
    u.link_targets("http://x.org/", "<link " + "a" * 500_000 + ">")
    assert time.perf_counter() - began < 8


def test_classes_match_a_plain_search(spark):
    """Random links and rules against a search of each url's class."""
    import random

    rng = random.Random(4)
    urls = [f"http://h{k % 9}.org/p{k}" for k in range(80)]
    rules = [u.Rule("h1.org", "/p1", "block"), u.Rule("h2.org", "/", "block"), u.Rule("h3.org", "/p3", "allow"), u.Rule("h5.org", "/p50", "allow")]
    links = [(rng.choice(urls), rng.choice(urls)) for _ in range(45)]
    own = lambda x: max(((len(r.name), r.verdict) for r in rules if x.startswith(f"http://{r.host}{r.path}")), default=(0, None))[1]
    got = run(spark, [page(k, x) for k, x in enumerate(urls)], rules, links)
    for k, x in enumerate(urls):
        seen, todo = {x}, [x]
        while todo:
            y = todo.pop()
            for a, b in links:
                for c in ([b] if a == y else []) + ([a] if b == y else []):
                    if c not in seen:
                        seen.add(c)
                        todo.append(c)
        said = {own(y) for y in seen}
        assert got[k]["verdict"] == (own(x) or ("allow" if "allow" in said else "block" if "block" in said else "allow"))
