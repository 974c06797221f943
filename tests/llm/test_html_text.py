from __future__ import annotations

import pytest

from sievecraft.llm.html_text import extract_text, main_text

P1 = "The first paragraph is long enough, with a comma or two, to count as content of the page."
P2 = "The second paragraph, also long enough, goes on about the same matter for a while."
LONG = f"<p>{P1}</p><p>{P2}</p>"


def page(body, head="<title>T</title><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<nav><a href=x>Home</a></nav><article><h1>Title</h1>{LONG}</article><footer>&copy; x</footer>", f"Title\n{P1}\n{P2}"),
        (f"<div class=menu><p>{P1}</p></div><div id=main>{LONG}</div>", f"{P1}\n{P2}"),
        (f"<div class='wrap has-sidebar'>{LONG}<div class=sidebar><p>{P2}</p></div></div>", f"{P1}\n{P2}"),
        (f"<main>{LONG}<form><p>{P1}</p></form><section id=comments><p>{P2}</p></section></main>", f"{P1}\n{P2}"),
        (f"<article>{LONG}<script>var t='</p><p>no</p>';</script><!-- <p>no</p> --></article>", f"{P1}\n{P2}"),
        (f"<article><p><b>{P1}<br>more<p>{P2}", f"{P1} more\n{P2}"),
        (f"<article>{LONG}<ul><li>one<li>two &amp; three</ul><p>a&nbsp;b &lt;i&gt; &#233;</p></article>", f"{P1}\n{P2}\none\ntwo & three\na b <i> é"),
        (f"<article>{LONG}<p>cut <a hre", f"{P1}\n{P2}\ncut"),
        (f"<div><p>{P1}</p></div><div><a href=1>{P1}</a><a href=2>{P2}</a></div>", P1),
        (f"<div role=alert><p>{P1}</p></div><div hidden><p>{P1}</p></div><div><p>{P2}</p></div>", P2),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{LONG}</article>", f"Title\n{P1}\n{P2}"),
        (f"<table><tr><td>{P1}<td>{P2}</table>", f"{P1}\n{P2}"),
        ("Only a short text", "Only a short text"),
        ("<article><h1>Short</h1><p>A b.</p></article><footer>far longer than the article itself, with commas, yes</footer>", "Short\nA b."),
    ],
)
def test_main_text(body, text):
    assert main_text(page(body)) == text


def test_furniture_larger_than_the_article_is_left_out():
    comments = "".join(f"<p>Reader {k} has a long opinion, with commas, about this and that matter.</p>" for k in range(20))
    assert main_text(page(f"<article>{LONG}</article><section class=comments>{comments}</section>")) == f"{P1}\n{P2}"
    assert main_text(page(f"<main>{LONG}<section id=comments>{comments}</section></main>")) == f"{P1}\n{P2}"
    assert main_text(page(f"<div>{LONG}</div><div class=comments>{comments}</div>")) == f"{P1}\n{P2}"
    wrapped = f"<div class=overlay><article>{LONG}</article><section class=comments>{comments}</section></div>"
    assert main_text(page(wrapped)) == f"{P1}\n{P2}"
    assert main_text(page(f"<div class=widget>{LONG}</div><div><p>A line of the site, long enough.</p></div>")).startswith(P1)


def paras(name, n=12):
    own = [f"Paragraph {k} of {name} is long enough, with a comma, to count as content." for k in range(n)]
    return "".join(f"<p>{x}</p>" for x in own), "\n".join(own)


def test_parts_of_an_article_are_kept():
    a, text_a = paras("a")
    b, text_b = paras("b")
    both = f"{text_a}\n{text_b}"
    assert main_text(page(f"<article><div class=row><section>{a}</section></div><div class=row><section>{b}</section></div></article>")) == both
    assert main_text(page(f"<div id=content><div class=row><div>{a}</div></div><div class=row><div>{b}</div></div></div><div class=footer>x</div>")) == both
    assert main_text(page(f"<article><div class='entry-header'><h1>Title</h1></div>{a}</article>")) == f"Title\n{text_a}"
    assert main_text(page(f"<div class='entry-header'><h1>Title</h1></div><div>{a}</div>")) == f"Title\n{text_a}"
    assert main_text(page(f"<article>{a}<section id='discussion'>{b}</section></article>")) == both
    assert main_text(page(f"<article>{a}<div class='search-algorithms'>{b}</div></article>")) == both
    assert main_text(page(f"<div><div>{a}</div><p>A short last line.</p></div>")) == f"{text_a}\nA short last line."
    assert main_text(page(f"<article>{a}<p>Where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><xmp>code</xmp></article>")) == f"{text_a}\nWhere x=1 holds.\ncode"


def test_named_furniture_is_left_out():
    a, text_a = paras("a")
    link = "<a href=x>A related story, linked from here</a>"
    for name in ("site-footer", "cookie-banner", "sidebar-right", "post-comments", "commentList", "adSlot top", "js-newsletter-box", "menu", "notice", "entry-reply"):
        assert main_text(page(f"<article>{a}<div class='{name}'><p>{P1}</p></div></article>")) == text_a, name
        assert main_text(page(f"<div>{a}</div><div id='{name}'><p>{P1}</p></div>")) == text_a, name
    for name in ("related", "search", "discussion", "share-links"):
        assert main_text(page(f"<article>{a}<div class='{name}'><p>{link}</p></div></article>")) == text_a, name


def test_a_short_article_beside_a_long_advert():
    assert main_text(page(f"<div class=ad>{P1}</div><article><h1>T</h1><p>Short text.</p></article>")) == "T\nShort text."


def shape(node):
    """A tree of (name, class, children or text) as html."""
    name, kind, inner = node
    return f"<{name}{f' class={kind}' if kind else ''}>{inner if isinstance(inner, str) else ''.join(map(shape, inner))}</{name}>"


def random_tree(rng, depth=0):
    if depth and (depth == 4 or rng.random() < 0.45):
        words = rng.choice((3, 9, 30, 60))
        text = " ".join(rng.choice(("word", "comma,", "other")) + str(rng.randrange(99)) for _ in range(words))
        return (rng.choice(("p", "p", "p", "h2")), "", f"<a>{text}</a>" if rng.random() < 0.2 else text)
    name = "body" if not depth else rng.choice(("div", "div", "section", "article"))
    return (name, rng.choice(("", "", "", "sidebar", "text")) if depth else "", [random_tree(rng, depth + 1) for _ in range(rng.randrange(1, 5))])


def test_container_agrees_with_a_recursive_scorer():
    """Points, discounts and the choice of the container, worked out by plain recursion over the tree itself."""
    import random

    def gone(node):
        return node[1] == "sidebar"

    def texts(node):
        name, _, inner = node
        if isinstance(inner, str):
            bare = inner.removeprefix("<a>").removesuffix("</a>")
            return [(name, bare, len(bare.replace(" ", "")) if bare != inner else 0)]
        return [x for child in inner if not gone(child) for x in texts(child)]

    def points(node):
        own = texts(node)
        plain = sum(1 + t.count(",") + min(len(t) / 100, 3) for n, t, _ in own if n != "h2" and len(t) >= 25)
        return plain * (1 - sum(k for _, _, k in own) / max(1, sum(len(t) for _, t, _ in own)))

    def choose(node):
        inner = [c for c in node[2] if not isinstance(c[2], str) and not gone(c) and texts(c)] if not isinstance(node[2], str) else []
        if not inner:
            return node
        named = [c for c in inner if c[0] == "article" and (2 * points(c) >= points(node) or not points(node))]
        top = named[0] if len(named) == 1 else max(inner, key=points)
        return choose(top) if len(named) == 1 or (points(node) and points(top) >= 0.7 * points(node)) else node

    rng, seen = random.Random(21), 0
    for _ in range(400):
        tree = random_tree(rng)
        sidebars = shape(tree).count("sidebar")
        if sidebars and not texts(tree):
            continue  # nothing stands beside the furniture
        chosen = "\n".join(t for _, t, _ in texts(choose(tree)))
        got = main_text(f"<html>{shape(tree)}</html>")
        if not sidebars:
            assert chosen in got
            seen += chosen == got
    assert seen > 100


@pytest.mark.parametrize(
    "unit",
    ["<b>", "</i>", "<b></i>", "<i><div>", "<!--", "<a <a ", "<a x='", "</title ", "<title></title ", "<svg>", "<li><ul>", "<p><b>", "<div class=comments>", "<td>", "</", "<p>x</p></div>", "&", "<div class='sidebar comments'><p>Text that is long enough to count</p>"],
)
def test_hostile_markup_takes_linear_time(unit):
    import time

    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    main_text(text)
    main_text("<b>" * 4000 + "</i>" * 4000 + text[:1000])
    assert time.perf_counter() - began < 12


@pytest.mark.parametrize("html", [None, "", "<", "<p", "</", "<!--", "<script>", "&", "<nav>x</nav>", "<a <b <c>", "<p>" * 3000, "<div>" * 3000 + "x"])
def test_broken_pages_do_not_crash(html):
    assert main_text(html) in ("", "&", "x")


def test_table(spark):
    rows = [(1, "u", page(f"<article>{LONG}</article>"), 5), (1, "u", page(f"<article>{LONG}</article>"), 5), (2, None, None, None), (3, "v", "", 1)]
    out = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [r["text"] for r in out] == [f"{P1}\n{P2}"] * 2 + ["", ""]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
