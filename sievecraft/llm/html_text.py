"""Main text of HTML pages by tree scoring.

Every paragraph passes points for its length and commas to all its ancestors, and an element's points are discounted by
the share of its text that stands in links. From the root, the best container is the lowest element that still holds
most of the points of the one above it; siblings that look like it are kept with it. Navigation, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments are left out first: by element, role or hidden state,
and by class or id where all words of one name say so (``site-footer``, ``cookie-banner``, but not ``entry-header`` or
``search-algorithms``), unless the element wraps the article itself. Words that may as well name a part of an article
(``discussion``, ``search``) count only where the element's text is mostly links.

Nulls: a null or empty page has an empty text. Broken pages (open tags, cut ends) are read to their end; a tag that the
end cuts off is dropped. Reading takes time in proportion to a page's length, whatever its markup; no length is cut.
Pages are read one by one, so repeated rows and hot hosts need no care, and nothing is shuffled. An empty table gives an
empty result; a column of the output's name is replaced, others are passed on.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

# Element names of the HTML standard and words that sites use in class and id attributes.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "canvas", "object", "video", "audio", "title", "select", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "xmp",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold text themselves and are no container of an article.
TEXTUAL = HEADINGS | {"p", "pre", "xmp", "li", "blockquote", "dd", "dt", "figcaption", "caption", "th", "summary", "address"}
DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label", "legend", "option", "head"}
DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist", "status"}
FURNITURE = {
    "ad", "ads", "adbox", "adslot", "adsense", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promos", "promoted",
    "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "popup", "modal", "overlay", "interstitial", "paywall",
    "newsletter", "subscribe", "signup", "signin", "login", "breadcrumb", "breadcrumbs", "pagination", "pager", "sidebar", "sidebars", "nav", "navbar", "navigation", "menu", "menus", "submenu",
    "footer", "masthead", "header", "topbar", "toolbar", "widget", "widgets", "tagcloud",
}
REPLIES = {"comment", "comments", "commentlist", "disqus", "respond", "reply", "replies"}
ADVERTS = {"ad", "ads", "adbox", "adslot", "adsense", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promos", "promoted"}
#: Count only where the text is mostly links.
UNSURE = {"discussion", "search", "related", "recommended", "recommendations", "trending", "popular", "social", "share", "sharing", "shares", "copyright", "disclaimer", "register", "subscription", "promotion", "alert", "rail", "skip", "links"}
#: Words that say where or how large, not what.
PLAIN = {
    "site", "page", "main", "top", "bottom", "left", "right", "upper", "lower", "first", "last", "primary", "secondary", "global", "fixed", "sticky", "mobile", "desktop", "list", "item", "items", "box", "wrap", "wrapper",
    "container", "inner", "outer", "area", "section", "block", "panel", "holder", "row", "col", "column", "bar", "unit", "slot", "group", "module", "region", "zone", "small", "big", "large", "mini", "form", "link", "links",
    "title", "text", "content", "message", "policy", "user", "users", "reader", "readers", "js", "the", "is", "has", "no", "new", "tree", "thread", "feed",
}
CONTENT = {"article", "content", "post", "entry", "story", "body", "text"}

_CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
    "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"},
}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(?P<loose>[a-zA-Z][^\s/>]*)(?P<looserest>[^>]*)>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<(?:[a-zA-Z/!?][^>]*)?\Z|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: A paragraph counts from this many characters.
LEAST_CHARS = 25
#: Share of an element's points that a child must hold to be a better container.
MOST = 0.7
#: Share of link text from which an element is a list of links.
LINKED = 0.33


class _Node:
    __slots__ = ("chars", "dropped", "end", "heads", "kind", "links", "name", "parent", "para", "points")

    def __init__(self, name: str, parent: int, kind: str, dropped: bool):
        self.name, self.parent, self.kind, self.dropped = name, parent, kind, dropped
        self.points, self.chars, self.links, self.heads, self.para, self.end = 0.0, 0, 0, 0, 0, -1


def _kind(value: str) -> str:
    """What a class or id says: "replies", "furniture", "unsure" (furniture if mostly links) or nothing. Each name counts
    as a whole: all its words must be furniture or plain, but for comments and adverts of an article (``post-comments``)."""
    found = ""
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        own = [w for w in words if w not in PLAIN] or words
        said = set(own)
        if not own:
            continue
        if own[-1] in REPLIES | ADVERTS and said <= REPLIES | ADVERTS | FURNITURE | CONTENT:
            return "replies"
        if said <= FURNITURE | REPLIES:
            found = "furniture"
        elif said <= UNSURE | FURNITURE | REPLIES and not found:
            found = "unsure"
    return found


def _marks(rest: str) -> tuple[str, bool]:
    """What class and id say; whether an attribute hides the element or gives it the role of page furniture."""
    kind, hide = "", False
    if rest and rest != "/":
        for m in _ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                said = _kind(value)
                kind = said if said == "replies" or not kind or (kind == "unsure" and said) else kind
            elif key == "role":
                hide |= value.strip().lower() in DROP_ROLES
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDDEN.search(value)):
                hide = True
    return kind, hide


class _Reader:
    """Nodes in page order, and blocks (node, text, characters in links), in one pass. Open elements are found by name
    and by kind from lists of stack positions, never by a walk down the stack."""

    def __init__(self, page: str):
        self.page = page
        self.nodes = [_Node("#root", -1, "", False)]
        self.stack, self.blocks, self.parts = [0], [], []
        self.open: dict[str, list[int]] = {}
        self.open_blocks: list[int] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(x for x, _ in self.parts).split())
            if text:
                at = self.stack[self.open_blocks[-1]] if self.open_blocks else 0
                self.blocks.append((at, text, sum(len("".join(x.split())) for x, linked in self.parts if linked)))
            self.parts.clear()

    def push(self, node: _Node) -> None:
        self.nodes.append(node)
        self.open.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCK:
            self.open_blocks.append(len(self.stack))
        self.stack.append(len(self.nodes) - 1)

    def pop(self, to: int) -> None:
        """Close the open elements from stack position ``to`` on."""
        while len(self.stack) > to:
            x = self.nodes[self.stack.pop()]
            x.end = len(self.nodes)
            if self.stack:
                self.open[x.name].pop()
                if x.name in BLOCK:
                    self.open_blocks.pop()

    def last(self, names: set[str]) -> int:
        """Stack position of the innermost open element of these names, 0 if none is open."""
        return max((own[-1] for x in names if (own := self.open.get(x))), default=0)

    def start(self, name: str, rest: str) -> None:
        if name in BLOCK:
            self.flush()
            if self.open_blocks and self.nodes[self.stack[self.open_blocks[-1]]].name == "p":
                self.pop(self.open_blocks[-1])  # a block ends an open paragraph
        if name in _CLOSED_BY:
            fence = self.last(_FENCE[name])
            inside = [own[k] for x in _CLOSED_BY[name] if (own := self.open.get(x)) and (k := bisect.bisect_right(own, fence)) < len(own)]
            if inside:
                self.pop(min(inside))
        kind, hide = _marks(rest)
        drop = self.nodes[self.stack[-1]].dropped or hide or name in DROP or (name == "header" and not self.open.get("article") and not self.open.get("main"))
        node = _Node(name, self.stack[-1], kind, drop)
        if not rest.endswith("/") or name in BLOCK:
            self.push(node)
        else:
            self.nodes.append(node)
            node.end = len(self.nodes)

    def finish(self, name: str) -> None:
        own = self.open.get(name)
        if name in BLOCK:
            self.flush()
        if own and (name in BLOCK or not self.open_blocks or own[-1] > self.open_blocks[-1]):
            self.pop(own[-1])

    def skip(self, name: str, at: int) -> int:
        """Where an element of raw text ends."""
        close = re.compile(rf"</{re.escape(name)}(?=[\s/>])|</{re.escape(name)}\Z", re.I).search(self.page, at)
        end = self.page.find(">", close.end()) if close else -1
        return end + 1 if end >= 0 else len(self.page)

    def read(self) -> tuple[list[_Node], list[tuple[int, str, int]]]:
        at, size = 0, len(self.page)
        while at < size:
            m = _TOKEN.match(self.page, at)
            at = m.end()
            name = (m["name"] or m["loose"] or "").lower()
            if m["text"] is not None:
                self.parts.append((html.unescape(m["text"]), bool(self.open.get("a"))))
            elif name:
                rest = m["rest"] if m["name"] else m["looserest"]
                if name in RAW:
                    if not rest.endswith("/") or name != "svg":
                        at = self.skip(name, at)
                elif name == "br":
                    self.parts.append((" ", False))
                elif name in VOID:
                    if name == "hr":
                        self.flush()
                else:
                    self.start(name, rest)
            elif m["end"]:
                self.finish(m["end"].lower())
        self.flush()
        self.pop(0)
        return self.nodes, self.blocks


def _leave_out(nodes: list[_Node], blocks: list[tuple[int, str, int]]) -> None:
    """Mark elements whose class or id names page furniture, unless they wrap the article.

    An element with an article or main inside that isn't furniture itself is a wrapper. Else comments and adverts are
    left out wherever other text remains, and furniture where it holds at most half of the page's paragraphs or an
    article or main stands outside.
    """
    chars, links, para, within = ([0] * len(nodes) for _ in range(4))
    for k, text, linked in blocks:
        if not nodes[k].dropped:
            chars[k] += len(text)
            links[k] += linked
            para[k] += len(text) if len(text) >= LEAST_CHARS and nodes[k].name not in HEADINGS else 0
    for k in range(len(nodes) - 1, 0, -1):
        x = nodes[k]
        within[k] |= x.name in ("article", "main") and chars[k] > 0 and not x.dropped and x.kind != "replies"
        for sums in (chars, links, para):
            sums[x.parent] += sums[k]
        within[x.parent] |= within[k]
    mark = lambda x: x.kind if x.name not in ("html", "body", "main") else ""
    named = [mark(x) in ("replies", "furniture") and not (x.name == "article" and x.kind == "furniture") for x in nodes]
    named = [n and not (within[k] and nodes[k].name != "article") for k, n in enumerate(named)]
    free, free_article, under = False, False, [False] * len(nodes)
    inside = [False] * len(nodes)
    for k, x in enumerate(nodes):
        if k:
            under[k] = named[k] or under[x.parent]
            inside[k] = inside[x.parent] or x.name in ("article", "main")
    for k, _, _ in blocks:
        if not nodes[k].dropped and not under[k]:
            free = True
            free_article |= inside[k]
    for k, x in enumerate(nodes):
        if not k or x.dropped:
            continue
        if nodes[x.parent].dropped:
            x.dropped = True
        elif named[k]:
            x.dropped = free if x.kind == "replies" else para[k] * 2 <= para[0] or free_article
        elif x.kind == "unsure" and x.name not in ("html", "body", "main", "article"):
            x.dropped = links[k] > LINKED * chars[k]


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by one line feed; empty if the page has none."""
    if not page:
        return ""
    nodes, blocks = _Reader(page).read()
    _leave_out(nodes, blocks)
    kept = [(k, text, linked) for k, text, linked in blocks if not nodes[k].dropped]
    if not kept:
        return ""
    for k, text, linked in kept:
        x = nodes[k]
        x.chars += len(text)
        x.links += linked
        if x.name in HEADINGS:
            x.heads += len(text)
        elif len(text) >= LEAST_CHARS:
            x.points += 1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)
    own = [x.points if x.name not in TEXTUAL else 0.0 for x in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        up, x = nodes[nodes[k].parent], nodes[k]
        for part in ("points", "chars", "links", "heads"):
            setattr(up, part, getattr(up, part) + getattr(x, part))

    def score(k: int) -> float:
        return nodes[k].points * (1 - nodes[k].links / max(1, nodes[k].chars))

    children: dict[int, list[int]] = {}
    for k in range(1, len(nodes)):
        if not nodes[k].dropped and nodes[k].chars:
            children.setdefault(nodes[k].parent, []).append(k)
    best, at = 0, 0
    while True:
        inner = [c for c in children.get(at, ()) if nodes[c].name not in TEXTUAL]
        if not inner:
            break
        top = max(inner, key=lambda c: (score(c), -c))
        # An article or main needs only most of the points; an article of few words is one by its name.
        named = [c for c in inner if nodes[c].name in ("article", "main") and (2 * score(c) >= score(at) or not score(at))]
        if len(named) == 1:
            top = named[0]
        elif not score(at) or score(top) < MOST * score(at) or own[at] > (1 - MOST) * score(at):
            break
        at = top
        if nodes[at].name in BLOCK:
            best = at
    keep = [best]
    if best:
        least = max(10.0, 0.2 * score(best))
        for k in children.get(nodes[best].parent, ()):
            x = nodes[k]
            thin = x.links <= LINKED * x.chars
            title = k < best and thin and x.heads == x.chars
            if k != best and thin and (score(k) >= least or x.name in ("p", "blockquote", "pre", "h1") or title):
                keep.append(k)
    out, spans = [], sorted((k, nodes[k].end) for k in keep)
    turn = 0
    for k, text, _ in kept:
        while turn < len(spans) and spans[turn][1] <= k:
            turn += 1
        if turn < len(spans) and spans[turn][0] <= k:
            out.append(text)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def _main_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(main_text)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Append ``out``, the main text of each page; a column of that name is replaced."""
    small_batches(pages.sparkSession)
    return pages.withColumn(out, _main_text(F.col(html_col)))
