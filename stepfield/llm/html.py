"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A leaf block is a run of text between block tags. Its features are the tags, classes, ids and roles of its ancestors,
what its text looks like, and whether it lies in the container that holds most of the page's prose or in one of many
alike. The field has two labels (article or not), weights for each feature and for neighbouring
labels; it is trained by maximum likelihood on pages of `labelled_pages`, which writes pages of many layouts with the
label of every block, and decoded by Viterbi. Scripts, styles, form controls, fallbacks and comments of the
markup are not text at all.

Pages are cut into tags and text by rules that no markup can break: what HTML calls a bogus comment is one, and a tag,
comment or quoted value that is never closed takes the rest of the page. Every character is looked at a bounded number
of times, so reading takes time in proportion to a page's length, whatever its faults and however deep its elements lie.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, ship, slices

#: Fixed values of HTML: elements without an end tag, elements whose content is no text, elements that end a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript textarea select datalist button iframe object svg audio video canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: A closing tag of another element does not reach beyond these.
SECTIONS = frozenset("html body article section main div nav header footer aside form ul ol table tr td th tbody thead figure dialog fieldset blockquote details".split())
#: These hold the parts of a page; all other elements belong to the part that they are in.
PARTS = frozenset("html body article section main div nav header footer aside form td th dialog details center fieldset".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Elements that end at their own end tag only; references are decoded in the latter.
RAW, PLAIN = frozenset(["script", "style"]), frozenset(["title", "textarea"])

_TAG = re.compile(r"[A-Za-z][^\t\n\r\f />\x00]*")
_GAP = re.compile(r"[\t\n\r\f /]*")
_ATTRIBUTE = re.compile(r"([^\t\n\r\f />][^\t\n\r\f />=]*)[\t\n\r\f ]*(=?)[\t\n\r\f ]*")
_BARE = re.compile(r"[^\t\n\r\f >]*")
_COMMENT_END = re.compile(r"--!?>")
_DOCTYPE = re.compile(r"<!doctype[^\[>]*(\[[^\]]*\][\t\n\r\f ]*)?>", re.IGNORECASE)
_RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\r\f />])", re.IGNORECASE) for t in (*RAW, *PLAIN)}
_ZEROS, _HUGE = re.compile(r"(&#[xX]?)0+(?=[0-9a-fA-F])"), re.compile(r"&#[0-9]{8,};?")

_NAME = re.compile(r"[^0-9A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…]['\")\]]*(?:\s|$)")


class Block:
    __slots__ = ("text", "marks", "tag", "linked", "part", "like")

    def __init__(self, text: str, marks: tuple[str, ...], tag: str, linked: float, part: int, like: tuple[str, ...] | None):
        self.text, self.marks, self.tag, self.linked, self.part, self.like = text, marks, tag, linked, part, like


def decoded(text: str) -> str:
    """Text with its character references decoded; numbers of any length are allowed."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub(r"\1", text))
    return unescape(text)


def attributes(html: str, at: int) -> tuple[list[tuple[str, str | None]], int, bool] | None:
    """Attributes from `at`, where their tag ends, and whether it closes itself. None: the page ends first."""
    out = []
    while True:
        gap = _GAP.match(html, at)
        at = gap.end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return out, at + 1, gap[0].endswith("/")
        m = _ATTRIBUTE.match(html, at)
        at, value = m.end(), None
        if m[2]:
            quote = html[at : at + 1]
            if quote in ("'", '"'):
                end = html.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1 : end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
            value = decoded(value)
        out.append((m[1].lower(), value))


def declaration_end(html: str, at: int) -> int:
    """Where the comment or declaration from `at` ("<!" or "<?") ends."""
    if html.startswith("<!--", at):
        for short in ("<!-->", "<!--->"):
            if html.startswith(short, at):
                return at + len(short)
        end = _COMMENT_END.search(html, at + 4)
        return end.end() if end else len(html)
    if html.startswith("<![CDATA[", at):
        end = html.find("]]>", at)
        if end >= 0:
            return end + 3
    doctype = _DOCTYPE.match(html, at)
    if doctype:
        return doctype.end()
    end = html.find(">", at)
    return end + 1 if end >= 0 else len(html)


class _Reader:
    """known: marks that count (None: all)."""

    def __init__(self, known: frozenset[str] | None = None):
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}  # of each open tag
        self.sections: list[int] = []
        self.solid: list[str] = []  # open tags that are not inline
        self.open_parts = [0]
        self.named: list[tuple[str, ...]] = []  # marks of open parts with a name
        self.parents, self.tags = [0], [""]  # of each part
        self.alike: dict[tuple[str, ...], int] = {}
        self.marks: dict[str, int] = {}
        self.now: tuple[str, ...] | None = ()
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.links = 0

    def feed(self, html: str) -> None:
        at = 0
        while at < len(html):
            to = html.find("<", at)
            if to < 0:
                to = len(html)
            if to > at:
                self.handle_data(decoded(html[at:to]))
            at = to
            after = html[at + 1 : at + 3]
            if not after:
                self.handle_data(html[at:])
                return
            if after[0] in "!?":
                at = declaration_end(html, at)
                continue
            closing = after[0] == "/"
            name = _TAG.match(html, at + 1 + closing)
            if name is None:
                if closing:  # "</>" and the like
                    at = html.find(">", at) + 1 or len(html)
                else:
                    self.handle_data("<")
                    at += 1
                continue
            tag, got = name[0].lower(), attributes(html, name.end())
            if got is None:
                return
            attrs, at, closed = got
            if closing:
                self.handle_endtag(tag)
            elif closed:
                self.handle_startendtag(tag, attrs)
            else:
                self.handle_starttag(tag, attrs)
                if tag in _RAW_END:
                    end = _RAW_END[tag].search(html, at)
                    to = end.start() if end else len(html)
                    self.handle_data(html[at:to] if tag in RAW else decoded(html[at:to]))
                    at = to

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                if self.now is None:
                    self.now = tuple(self.marks)
                self.blocks.append(Block(text, self.now, self.solid[-1] if self.solid else "none", min(1.0, self.linked / len(text)), self.open_parts[-1], self.named[-1] if self.named else None))
            self.parts, self.linked = [], 0

    def leave(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, marks = self.stack.pop()
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            self.places[tag].pop()
            if tag in SECTIONS:
                self.sections.pop()
            if tag not in INLINE:
                self.solid.pop()
            if tag in PARTS:
                self.open_parts.pop()
                if len(marks) > 1:
                    self.named.pop()
            for m in marks:
                if m in self.marks:
                    self.marks[m] -= 1
                    if not self.marks[m]:
                        del self.marks[m]
                        self.now = None

    def close_open(self, tag: str) -> None:
        at = self.places.get(tag)
        if at and (tag in SECTIONS or not self.sections or self.sections[-1] < at[-1]):
            self.leave(at[-1])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in CLOSES_P:
            self.close_open("p")
        if tag in ("li", "option", "dt", "dd"):
            self.close_open(tag)
        if tag in VOID:
            return
        marks = [f"<{tag}>"]
        for k, v in attrs:
            if k in ("class", "id", "role") and v:
                marks += [f"{'role' if k == 'role' else 'name'}={w.lower()}" for w in _NAME.split(v) if w]
        marks = tuple(marks)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SECTIONS:
            self.sections.append(len(self.stack))
        if tag not in INLINE:
            self.solid.append(tag)
        if tag in PARTS:
            self.parents.append(self.open_parts[-1])
            self.tags.append(tag)
            self.open_parts.append(len(self.parents) - 1)
            if len(marks) > 1:
                self.named.append(marks)
                self.alike[marks] = self.alike.get(marks, 0) + 1
        self.stack.append((tag, marks))
        for m in marks:
            if self.known is None or m in self.known:
                self.marks[m] = self.marks.get(m, 0) + 1
                self.now = None
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.close_open(tag)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


class Page(list):
    """Leaf blocks in page order; parents and tags of the page's parts, and how many parts have the same names."""

    parents: list[int]
    tags: list[str]
    alike: dict[tuple[str, ...], int]


def leaf_blocks(html: str, known: frozenset[str] | None = None) -> Page:
    """No markup raises an error; no text is lost but that of silent elements and that behind a tag, comment or quote that is never closed."""
    r = _Reader(known)
    r.feed(html)
    r.flush()
    page = Page(r.blocks)
    page.parents, page.tags, page.alike = r.parents, r.tags, r.alike
    return page


def features(blocks: Page) -> list[list[str]]:
    words = [b.text.count(" ") + 1 for b in blocks]
    ends = [len(_SENTENCE.findall(b.text)) for b in blocks]
    def inside(part: int) -> list[bool]:
        """Of each part, whether it is or lies in that one. A part comes after the one that it is in."""
        out = [False] * len(blocks.parents)
        for i, parent in enumerate(blocks.parents):
            out[i] = i == part or (i > 0 and out[parent])
        return out

    prose = [0] * len(blocks.parents)
    for b, n, e in zip(blocks, words, ends, strict=True):
        if b.linked <= 0.5 and (e or n > 7):
            prose[b.part] += n
    # Where a page has one article (or else one main), its text is there; in it the part with most words of prose.
    sole = next((t for t in ("article", "main") if blocks.tags.count(t) == 1), None)
    scope = inside(blocks.tags.index(sole) if sole else 0)
    top = max((i for i, s in enumerate(scope) if s), key=prose.__getitem__)
    within, total = inside(top), max(1, sum(prose))
    out, passed = [], False
    for i, (b, n, e) in enumerate(zip(blocks, words, ends, strict=True)):
        f = ["any", *b.marks, f"tag={b.tag}", f"words={min(8, n.bit_length())}", f"links={round(4 * b.linked)}", f"sentences={min(3, e)}"]
        f.append(f"shape={min(3, n.bit_length() // 2)},{b.linked > 0.5},{e > 0}")
        where = "top" if b.part == top else "within" if within[b.part] else "after" if passed else "before"
        passed = passed or b.part == top
        f += [where, f"{where},{b.linked > 0.5},{e > 0}", f"share={round(4 * prose[b.part] / total)}"]
        if sole:
            f.append(f"{'in' if scope[b.part] else 'outside'} the {sole}")
        if b.like is not None and b.part != top:
            f.append(f"alike={min(3, blocks.alike[b.like])}")
        if b.text[-1] in ".!?…":
            f.append("ends like a sentence")
        if "©" in b.text or "(c)" in b.text.lower() or "copyright" in b.text.lower():
            f.append("copyright")
        if i == 0:
            f.append("first")
        if i == len(blocks) - 1:
            f.append("last")
        out.append(f)
    return out


# --- Labelled pages ------------------------------------------------------------------------------------------------

_SYLLABLES = "ta ne ri so lu ka mi en or ath ing er qu de la ión é ß ver st on al ich ou".split()
MAIN_NAMES = ("content", "post", "entry-content", "article-body", "story", "main-text", "post-body", "text")
OTHER = {
    "nav": ("menu", "navbar", "breadcrumbs", "main-nav", "pagination", "toc", "tags", "share-links", "social"),
    "aside": ("sidebar", "related", "widget", "side-column", "recommended", "author-box"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot"),
    "notice": ("cookie-notice", "cookie", "consent", "notice", "alert", "gdpr-banner", "paywall", "popup", "modal"),
    "form": ("newsletter", "subscribe", "search", "login", "contact-form", "signup"),
    "comments": ("comments", "comment-list", "comment", "discussion", "replies", "reader-comments", "responses"),
    "header": ("header", "site-header", "masthead", "top-bar", "logo"),
    "footer": ("footer", "site-footer", "copyright", "bottom", "legal"),
}


def labelled_pages(n: int, seed: int = 7) -> Iterator[tuple[str, list[tuple[str, int]]]]:
    """(html, [(text of a block, 1 for the article's, else 0)]) of n invented pages."""
    rnd = random.Random(seed)

    def word() -> str:
        return "".join(rnd.choice(_SYLLABLES) for _ in range(rnd.randint(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rnd.randint(a, b))).capitalize()

    def sentences(k: int) -> str:
        mark = rnd.choice(("", "", "", "", "!!", "&&", "***"))
        return " ".join(words(2, 18) + rnd.choice("....,?!") + mark for _ in range(k))

    for _ in range(n):
        out: list[str] = []
        gold: list[tuple[str, int]] = []
        own_names = rnd.random() < 0.5  # a page whose names say nothing
        called: dict[str, str] = {}

        def name(kind: str, own_names=own_names, called=called) -> str:
            if own_names:
                return called.setdefault(kind, word())
            return rnd.choice(MAIN_NAMES if kind == "main" else OTHER[kind])

        def put(tag: str, text: str, label: int, inner: str = "", out=out, gold=gold) -> None:
            body = escape(text, quote=False)
            if label and rnd.random() < 0.2 and " " in body:
                a, b = body.split(" ", 1)
                body = rnd.choice((f"<b>{a}</b> {b}", f'<a href="/{a}">{a}</a> {b}', f"<em>{a} {b}" if tag == "p" else f"{a} <em>{b}</em>"))
            out.append(f"<{tag}{inner}>{body}" + ("" if tag == "p" and rnd.random() < 0.2 else f"</{tag}>"))
            gold.append((" ".join(text.split()), label))

        def links(k: int) -> None:
            out.append("<ul>")
            for _ in range(k):
                t = words(1, 3)
                out.append("<li>")
                out.append(f'<a href="/{t}">{escape(t)}</a></li>')
                gold.append((t, 0))
            out.append("</ul>")

        def open_(kind: str, tag: str | None = None) -> str:
            tag = tag or rnd.choice({"nav": ("nav", "div", "ul"), "aside": ("aside", "div", "section"), "ad": ("div", "aside", "ins-box"), "form": ("form", "div"), "comments": ("section", "div", "ol"), "header": ("header", "div"), "footer": ("footer", "div")}.get(kind, ("div", "section")))
            named = tag in ("div", "section", "ul", "ol", "ins-box") or rnd.random() < 0.5
            out.append(f'<{tag} {rnd.choice(("class", "id"))}="{name(kind)}">' if named else f"<{tag}>")
            return tag

        def comments() -> None:
            """Each in a part of its own, with who and when."""
            if rnd.random() < 0.5:
                put(rnd.choice(("h2", "h3", "p")), words(1, 3), 0)
            tag, own = rnd.choice(("div", "div", "li", "section", "article")), name("comments")
            for _ in range(rnd.randint(1, 6)):
                out.append(f'<{tag} class="{own}">')
                if rnd.random() < 0.7:
                    put(rnd.choice(("div", "p", "h4")), words(1, 2) + rnd.choice(("", ":", " 12:40", " 2021-03-04", ", May 3")), 0)
                for _ in range(rnd.randint(1, 2)):
                    put(rnd.choice(("p", "p", "div")), sentences(rnd.randint(1, 4)), 0)
                if rnd.random() < 0.3:
                    t = words(1, 1)
                    out.append(f'<div><a href="#r">{escape(t)}</a></div>')
                    gold.append((t, 0))
                out.append(f"</{tag}>")

        def other(kind: str) -> None:
            if kind == "comments" and rnd.random() < 0.6:
                return comments()
            if rnd.random() < 0.15:  # what isn't text
                out.append(rnd.choice(("<noscript>{}</noscript>", "<textarea name=c>{}</textarea>", "<select><option>{}</option></select>", "<button>{}</button>")).format(escape(sentences(1))))
            tag = open_(kind)
            if kind in ("nav", "footer", "header", "aside") and rnd.random() < 0.7:
                links(rnd.randint(1, 8))
            if kind == "footer":
                put("p", rnd.choice(("© ", "© 2020 ", "Copyright ", "")) + sentences(rnd.randint(1, 2)), 0)
            elif kind == "form":
                put("label", words(1, 4), 0)
                out.append('<input name="q"><button>')
                out.append(escape(words(1, 2)) + "</button>")
                if rnd.random() < 0.4:
                    put("p", sentences(1), 0)
            elif kind == "comments":
                for _ in range(rnd.randint(1, 5)):
                    put("p" if tag != "ol" else "li", sentences(rnd.randint(1, 4)), 0)
            elif kind != "nav":
                put(rnd.choice(("p", "div", "h3", "span") if kind != "ad" else ("p", "div")), words(2, 6) + "." if rnd.random() < 0.4 else sentences(rnd.randint(1, 3)), 0)
            out.append(f"</{tag}>")

        title = words(3, 9)
        bare = rnd.random() < 0.2  # a fragment: nothing but the text
        if not bare and rnd.random() < 0.2:
            out.append("<body>")
        elif not bare:
            out.append(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{escape(title)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
            gold.append((title, 0))
        for kind in () if bare else ("header", "nav", "notice", "ad"):
            if rnd.random() < (0.7 if kind == "nav" else 0.4):
                other(kind)
        if not bare and rnd.random() < 0.25:
            other("aside")
        shape = rnd.random() if not bare else rnd.choice((0.0, 0.8, 1.0, 1.0))
        table = not bare and rnd.random() < 0.12  # a layout by tables
        if table:
            shape = 1.0
            out.append(f"<table{rnd.choice(('', ' width=100%', ' border=0'))}><tr>")
            for _ in range(rnd.randint(1, 2)):
                out.append("<td>")
                if rnd.random() < 0.6:
                    links(rnd.randint(1, 6))
                else:
                    for _ in range(rnd.randint(1, 5)):
                        t = words(1, 3)
                        out.append(f'<a href="/x">{escape(t)}</a><br>')
                        gold.append((t, 0))
                out.append("</td>")
            out.append("<td>")
        tags = ["article"] if shape < 0.45 else ["main", "article"] if shape < 0.55 else ["main"] if shape < 0.65 else ["div"] if shape < 0.92 else []
        for t in tags:
            out.append(f'<{t} class="{name("main")}">' if t == "div" or rnd.random() < 0.3 else f"<{t}>")
        if rnd.random() < (0.4 if bare else 0.85):
            put("h1", title if rnd.random() < 0.7 else words(3, 9), 1)
        for i in range(rnd.choice((1, 1, 2, 3, 5, 8, 12))):
            kind = rnd.random()
            if kind < 0.7 or not i:
                put("p", sentences(rnd.choice((1, 1, 2, 3, 6, 20))), 1)
            elif kind < 0.75:
                put(rnd.choice(("h2", "h3")), words(2, 6), 1)
            elif kind < 0.8:
                put("blockquote", sentences(2), 1)
            elif kind < 0.84:
                out.append("<ul>")
                for _ in range(rnd.randint(2, 4)):
                    put("li", words(3, 12), 1)
                out.append("</ul>")
            elif kind < 0.87:
                put("pre", words(4, 20), 1)
            elif kind < 0.9:
                out.append("<table><tr>")
                for _ in range(rnd.randint(2, 4)):
                    put("td", words(1, 4), 1)
                out.append("</tr></table>")
            elif kind < 0.95:
                other(rnd.choice(("ad", "aside", "form", "notice")))
            else:
                put("p", words(1, 6) + ".", 1)
        if tags and not bare and rnd.random() < 0.2:
            other(rnd.choice(("comments", "nav", "footer", "aside")))
        out += [f"</{t}>" for t in reversed(tags)]
        if table:
            out.append("</td></tr><tr><td>")
            put("p", rnd.choice(("© ", "(c) 1999 ", "Copyright ", "")) + words(1, 6), 0)
            out.append("</td></tr></table>")
        for kind in () if bare else ("aside", "comments", "form", "ad", "notice", "footer"):
            if rnd.random() < (0.75 if kind == "footer" else 0.3):
                other(kind)
        if rnd.random() < 0.8:
            out.append("</body></html>")
        yield "".join(out), gold


# --- The field -----------------------------------------------------------------------------------------------------


class Field:
    """weights: what a feature adds to label 1 over label 0; steps[a][b]: for label b after a; opening: for the first label."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]], opening: list[float]):
        self.weights, self.steps, self.opening = weights, steps, opening
        self.known = frozenset(weights)

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most probable labels (Viterbi; ties to label 1)."""
        if not rows:
            return []
        get, ((s00, s01), (s10, s11)) = self.weights.get, self.steps
        back, (v0, v1) = [], self.opening
        for i, row in enumerate(rows):
            e = sum(get(f, 0.0) for f in row)
            if i:
                to0, to1 = (v0 + s00, v1 + s10), (v0 + s01, v1 + s11)
                back.append((to0[1] >= to0[0], to1[1] >= to1[0]))
                v0, v1 = max(to0), max(to1)
            v1 += e
        label = int(v1 >= v0)
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], steps: int = 120, rate: float = 0.1, ridge: float = 0.5) -> Field:
    """Maximum likelihood by gradient steps (Adam), all pages at once."""
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for r in rows for f in r}))}
    n, longest = len(pages), max(len(labels) for _, labels in pages)
    at, feature = zip(*((p * longest + t, names[f]) for p, (rows, _) in enumerate(pages) for t, r in enumerate(rows) for f in r), strict=True)
    at, feature = np.array(at), np.array(feature)
    size = np.array([len(labels) for _, labels in pages])
    gold = np.zeros((n, longest), int)
    for p, (_, labels) in enumerate(pages):
        gold[p, : len(labels)] = labels
    on = np.arange(longest) < size[:, None]
    theta = np.zeros(len(names) + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        w, trans, first = theta[:-6], theta[-6:-2].reshape(2, 2), theta[-2:]
        e = np.zeros((n, longest, 2))
        e[..., 1] = np.bincount(at, w[feature], minlength=n * longest).reshape(n, longest)
        alpha = np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + first
        for t in range(1, longest):
            new = np.logaddexp(alpha[:, t - 1, 0, None] + trans[0], alpha[:, t - 1, 1, None] + trans[1]) + e[:, t]
            alpha[:, t] = np.where(on[:, t, None], new, alpha[:, t - 1])
        total = np.logaddexp(*alpha[:, -1].T)
        beta, pair = np.zeros((n, 2)), np.zeros((2, 2))
        p1 = np.zeros((n, longest))
        for t in range(longest - 1, -1, -1):
            p1[:, t] = np.where(on[:, t], np.exp(alpha[:, t, 1] + beta[:, 1] - total), 0)
            if t:
                both = alpha[:, t - 1, :, None] + trans + (e[:, t] + beta)[:, None, :] - total[:, None, None]
                pair += np.where(on[:, t, None, None], np.exp(both), 0).sum(0)
                moved = np.logaddexp(trans[:, 0] + (e[:, t, 0] + beta[:, 0])[:, None], trans[:, 1] + (e[:, t, 1] + beta[:, 1])[:, None])
                beta = np.where(on[:, t, None], moved, beta)
        real = np.zeros((2, 2))
        np.add.at(real, (gold[:, :-1][on[:, 1:]], gold[:, 1:][on[:, 1:]]), 1)
        g = np.concatenate([np.bincount(feature, (p1 - gold * on).ravel()[at], minlength=len(names)), (pair - real).ravel(), [-(p1[:, 0] - gold[:, 0]).sum(), (p1[:, 0] - gold[:, 0]).sum()]])
        g = (g + ridge * theta) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in names.items()}, theta[-6:-2].reshape(2, 2).tolist(), theta[-2:].tolist())


def labels_of(blocks: list[Block], gold: list[tuple[str, int]]) -> list[int] | None:
    """Labels of a page's blocks; None where the blocks are not the labelled ones."""
    return [label for _, label in gold] if [b.text for b in blocks] == [t for t, _ in gold] else None


@lru_cache
def default_field(pages: int = 1000, seed: int = 7) -> Field:
    rows = []
    for html, gold in labelled_pages(pages, seed):
        blocks = leaf_blocks(html)
        labels = labels_of(blocks, gold)
        if labels is not None:
            rows.append((features(blocks), labels))
    return train(rows)


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html or "", field.known)
    return " ".join(b.text for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(page_id long, url, text string, n_chars long) for every row; text is empty where a page has none.

    A null html is an empty page. Pages are read one by one and as a whole, whatever their length or faults, so
    repeated rows give repeated results; an empty table gives none; only these columns are read.
    """
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h, shared.value) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_column).cast("long").alias("page_id"), "url", F.col(html_column).alias("html")).mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")
