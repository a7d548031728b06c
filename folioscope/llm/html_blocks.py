"""Pages as sequences of leaf blocks, and page layouts to learn from.

A leaf block is the text between two borders of block-level elements, with the
tags, classes, ids and roles of the elements around it.
"""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser
from typing import NamedTuple

#: Elements around whose tags a block ends, those that have no end tag, and those whose text is never read (fixed values of the format).
BORDERS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html iframe label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD = frozenset("audio button canvas datalist iframe noscript object script select style svg template textarea title video".split())
#: A start tag of the first kind closes an open element of the second, unless one of the third is nearer.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
#: A paragraph ends where any other border begins.
PARAGRAPH = ({"p"}, {"td", "th", "li", "div", "article", "section", "main", "body", "button", "table"})
#: Elements of a path that describe a block: the innermost ones.
DEPTH = 48
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block(NamedTuple):
    text: str
    path: tuple[str, ...]
    linked: int


def names(value: str | None) -> list[str]:
    """The words of a class, id or role: ``postComments-2`` gives post and comments."""
    return [x.lower() for x in NAME.findall(value or "")]


class Leaves(HTMLParser):
    """Collects the leaf blocks of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.pieces: list[str] = []
        self.linked = self.links = self.unread = 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            near = self.stack[-DEPTH:]
            path = [t for _, tokens in near for t in tokens]
            if near:
                path.append("i:" + next((t for t, _ in reversed(near) if t in BORDERS), near[-1][0]))
            self.blocks.append(Block(text, tuple(path), self.linked))
        self.pieces, self.linked = [], 0

    def pop(self, n: int) -> None:
        for tag, _ in self.stack[n:]:
            self.links -= tag == "a"
            self.unread -= tag in UNREAD
        del self.stack[n:]

    def close_open(self, closed: set[str], kept: set[str]) -> None:
        for i in range(len(self.stack) - 1, max(-1, len(self.stack) - 1 - DEPTH), -1):
            if self.stack[i][0] in closed:
                return self.pop(i)
            if self.stack[i][0] in kept:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BORDERS:
            self.flush()
            self.close_open(*PARAGRAPH)
            if tag in CLOSES:
                self.close_open(*CLOSES[tag])
        elif tag == "br":
            self.pieces.append(" ")
        if tag in VOID:
            return
        tokens = ["t:" + tag]
        for name, value in attrs:
            if name in ("class", "id", "role"):
                tokens += ["c:" + x for x in names(value)[:12]]
        self.stack.append((tag, tuple(tokens)))
        self.links += tag == "a"
        self.unread += tag in UNREAD

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as in browsers, the slash says nothing
        if tag in UNREAD:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        border = tag in BORDERS
        if border:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            open_tag = self.stack[i][0]
            if open_tag == tag:
                self.pop(i)
                return
            if not border and open_tag in BORDERS or tag == "p" and open_tag in PARAGRAPH[1]:
                return  # a stray end tag closes no block around it

    def handle_data(self, data: str) -> None:
        if not self.unread:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data)


def leaf_blocks(html: str | None) -> list[Block]:
    """The blocks of a whole page in page order; null and empty pages have none."""
    parser = Leaves()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.blocks


def within(block: Block) -> bool | None:
    """Whether a block of a page with semantic tags is of its article; None where the tags don't say."""
    tags = [t[2:] for t in block.path if t.startswith("t:")]
    begin = next((i for i, t in enumerate(tags) if t in ("article", "main")), None)
    if {"nav", "footer", "aside", "form"} & set(tags) or "header" in tags[:begin]:
        return False
    return None if begin is None else True


#: Containers of layouts, as tag and names: of articles, and of what surrounds them or stands in between, with the kind of their texts.
ARTICLES = (
    "article|main|main article|div:content|div:main content|div:post|div:post body|div:entry content|div:article body|section:story|div:page content|div:text|section:content|"
    "article:post|article:hentry|div:container div:article|main div:content article|div:body copy|div:blog post|div:news item|td:content|div:story body|main:main|div:role main|section|div"
).split("|")
AROUND = {
    "links": "nav|nav:menu|div:nav|div:navigation|div:navbar|ul:menu|div:menu|header nav|div:breadcrumb|nav:breadcrumbs|ol:breadcrumb|div:pagination|div:topics|ul:nav links|div:tags|div:share|div:social links|ul:social|div:toolbar|div:toc",
    "header": "header|div:header|div:masthead|div:banner|div:top bar|header:site header|div:logo|div:site title|div:branding|header:page header",
    "teaser": "aside|aside:sidebar|div:sidebar|div:side|div:widget|div:related|section:related|div:related posts|div:trending|div:popular|div:recommended|div:more stories|div:read more|aside:widget area|div:secondary|div:right column|section:recommendations",
    "ad": "div:ad|div:ads|div:advert|div:advertisement|div:sponsor|div:sponsored|div:promo|div:ad slot|aside:ad|section:promo|div:ad banner|ins:adsbygoogle|div:ad container|div:promotion|p:ad|div:partner",
    "notice": "div:cookie|div:cookie notice|div:cookie banner|div:consent|div:gdpr|div:notice|div:alert|div:popup|div:modal|div:newsletter|section:newsletter|div:paywall|div:subscribe|div:warning|div:announcement|div:role alert|div:notification|dialog|p:notice|aside:notice|div:disclaimer",
    "form": "form|form:search|div:search form|div:login|form:login|div:signup form|form:newsletter|form:contact|div:search|div:subscribe form|fieldset|form:comment form",
    "comment": "section:comments|div:comments|div:comment list|ol:comment list|div:replies|div:discussion|div:comments area|ul:comments|section:responses|div:disqus thread|aside:comments|div:user comments|div:reader comments|section:feedback|div:reviews",
    "footer": "footer|div:footer|div:copyright|footer:site footer|div:colophon|div:legal|div:bottom|footer:page footer|div:foot|div:imprint",
}
#: Elements around all of a page, and of texts.
WRAPPERS = ("div:wrapper", "div:container", "div:page", "div:site", "div:row", "div:col md", "div:layout", "div:inner", "div", "section", "div:main", "div:app root")
PARTS = {
    "article": ("p", "p", "p", "p", "p", "p", "h2", "h3", "ul li", "ol li", "blockquote p", "blockquote", "div", "figure figcaption", "pre", "table tr td", "dl dd", "p em", "section p"),
    "links": ("ul li a", "li a", "a", "p a", "div a", "span a"), "header": ("h1", "h2", "p", "a", "div", "div p", "h1 a"), "teaser": ("h3", "h2", "p", "ul li a", "li", "div a", "h4 a", "p a", "article p", "section p", "article h3 a"),
    "ad": ("", "p", "p", "a", "h3", "div", "span"), "notice": ("p", "p", "div", "", "span", "h3"), "form": ("label", "p", "legend", "span", "div label", "li"),
    "comment": ("p", "p", "div p", "li p", "article:comment p", "li:comment p", "div:comment body p", "div:comment p", "h3", "h2", "cite", "blockquote p", "div:reply p"), "footer": ("p", "", "ul li a", "div", "small", "span"),
}


def elements(spec: str, rng: random.Random) -> tuple[list[str], list[str]]:
    """Tokens and tags of ``tag:name name tag``; a name now and then has a stranger beside it."""
    tokens, tags = [], []
    for part in re.findall(r"(\w+)(?::([\w ]+?))?(?= \w+:|$| (?:nav|article|p|li|a|h3|div|tr|td|em|dd|figcaption|label)\b|$)", spec):
        tags.append(part[0])
        tokens.append("t:" + part[0])
        tokens += ["c:" + x for x in part[1].split()]
        if rng.random() < 0.15:
            tokens.append("c:" + rng.choice("alpha block box clear default fluid group inner large left right module outer primary small style theme wide".split()))
    return tokens, tags


def layout(rng: random.Random, paragraphs: list[str], short: list[str]) -> list[tuple[Block, bool]]:
    """A page of a random layout with the given texts: its blocks, and whether each is of the article."""

    def region(kind: str, base: list[str], spec: str, texts: list[str]) -> list[tuple[Block, bool]]:
        outer, tags = elements(spec, rng)
        out, mark = [], kind == "article"
        for text in texts:
            inner, more = elements(rng.choice(PARTS[kind]), rng) if PARTS[kind] else ([], [])
            last = next((t for t in reversed(tags + more) if t in BORDERS), (tags + more)[-1])
            linked = len(text) if "t:a" in inner else len(text) // 4 if mark and rng.random() < 0.1 else 0
            out.append((Block(text, tuple(base + outer + inner + ["i:" + last]), linked), mark))
        return out

    def odd(text: str) -> str:
        """Now and then a paragraph is a word or two, or has words that no other page has."""
        cut = rng.random()
        return text if cut > 0.15 else " ".join(text.split()[: rng.choice((1, 2))]) if cut > 0.06 else "".join(text.split())[: rng.choice((20, 200))] if cut > 0.03 else text[::-1]

    def texts(kind: str) -> list[str]:
        if kind == "article":
            return [odd(rng.choice(paragraphs)) for _ in range(rng.choice((1, 1, 2, 4, 6, 9, 14)))]
        if kind in ("links", "form", "footer", "header"):
            return [" ".join(rng.choice(short).split()[: rng.choice((1, 1, 2, 3, 6))]) or "x" for _ in range(rng.choice((1, 2, 5, 8)))]
        pool = short if rng.random() < 0.5 else paragraphs
        return [rng.choice(pool) for _ in range(rng.choice((1, 1, 2, 3, 5)))]

    def around(kind: str, base: list[str]) -> list[tuple[Block, bool]]:
        return region(kind, base, rng.choice(AROUND[kind].split("|")), texts(kind))

    base = ["t:html", "t:body"]
    for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
        base += elements(rng.choice(WRAPPERS), rng)[0]
    bare = rng.random() < 0.15  # nothing but the article
    chance = lambda p: rng.random() < p and not bare
    page = [x for kind, p in (("notice", 0.3), ("header", 0.5), ("links", 0.7), ("form", 0.2), ("ad", 0.4), ("teaser", 0.2), ("notice", 0.2)) if chance(p) for x in around(kind, base)]
    spec = rng.choice(ARTICLES)
    inside = base + elements(spec, rng)[0]
    if chance(0.8):  # a headline
        heading = ["t:header"] if chance(0.2) and {"t:article", "t:main"} & set(inside) else []
        page += [(Block(" ".join(rng.choice(paragraphs).split()[:12]), tuple(inside + heading + ["t:h1", "i:h1"]), 0), True)]
    for _ in range(rng.choice((1, 1, 2, 3))):
        page += region("article", base, spec, texts("article"))
        if chance(0.35):
            page += around(rng.choice(("ad", "notice", "teaser", "links", "form", "ad")), inside)
    if chance(0.3):
        page += around("comment", inside)
    page += [x for kind, p in (("links", 0.25), ("teaser", 0.4), ("comment", 0.4), ("form", 0.25), ("ad", 0.25), ("footer", 0.7), ("notice", 0.2)) if chance(p) for x in around(kind, base)]
    return page
