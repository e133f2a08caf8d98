"""Main text of web pages: boosted trees over DOM nodes, decoded so that kept nodes have kept ancestors.

A page is cut into tags and text; block elements make the nodes of a tree, inline
elements and line breaks belong to the text around them.  Every node gets
features of its tag, class, id and role tokens, its ancestors, depth, place among
its siblings, and the density of text, links and nodes in its subtree.  The
trees' log-odds go into a dynamic program over the tree: a node is kept if its
own odds and the best choice below it are worth it, and only below a kept parent;
so no kept text lies in a rejected menu, and a rejected advert can lie in a kept
article.

The trees are fitted to generated pages (seeded; ``PAGES`` of them) whose parts
are known, since no labelled pages exist.

Scripts (and what stands in for them: noscript, templates, frames), styles,
markup, drawings, text areas, comments in the markup and the head never count as
text; formulas, buttons, choices and the texts of embedded media do, as part of
the block around them.  A tag that the end of the page cuts off is markup, a
character reference that it cuts off is text.  A null or empty page gives an
empty text, bare text is one block of the body.  Very long pages are taken whole,
in batches of their own.  Repeated rows, also those without page_id, come out as
often as they came in.  Ties: a node whose odds are even is rejected.  An empty
table gives no rows.  Further columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .boosting import BoostedTrees

PAGES = 900

#: Element kinds of HTML.
BLOCKS = frozenset("html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary dialog center hgroup menu search".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset("head noscript template svg iframe".split())
#: Inline elements that stand apart from their neighbours.
APART = frozenset("option optgroup button select".split())
#: What may stand in a head; any other tag, or text, ends it.
IN_HEAD = frozenset("head html base basefont bgsound link meta noscript template title style script noframes".split())
#: Foreign elements, which a slash closes.
FOREIGN = frozenset(("svg",))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "li", "dt", "dd", "caption", "thead", "tbody", "tfoot", "legend", "figcaption"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Words of class, id and role by what they speak for.
HINTS = {
    "body": "article articlebody content main post entry story text body blog page news single prose copy",
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs tabs toc pager pagination topbar masthead header head toolbar logo branding skip",
    "foot": "footer foot bottom copyright colophon legal imprint",
    "side": "sidebar side aside widget related rail right left recommended more trending popular tags links archive secondary complementary",
    "advert": "ad ads advert advertisement adsense banner promo promotion sponsor sponsored dfp taboola outbrain affiliate",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog disclaimer privacy warning",
    "comment": "comment comments commentlist reply replies disqus discussion respond thread feedback reviews",
    "form": "form search login signin signup subscribe newsletter register contact share social sharing follow",
}
_HINT = {w: i for i, words in enumerate(HINTS.values()) for w in words.split()}
_KINDS = ("p", "h", "li", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "list", "table", "quote", "other")
_TAG = {"p": 0, **{f"h{i}": 1 for i in range(1, 7)}, "li": 2, "dt": 2, "dd": 2, "div": 3, "center": 3, "section": 4, "article": 5, "main": 6, "nav": 7, "menu": 7, "header": 8, "hgroup": 8, "footer": 9, "address": 9, "aside": 10, "dialog": 10, "form": 11, "fieldset": 11, "legend": 11, "search": 11, "ul": 12, "ol": 12, "dl": 12, "table": 13, "thead": 13, "tbody": 13, "tfoot": 13, "tr": 13, "td": 13, "th": 13, "caption": 13, "blockquote": 14, "pre": 14, "figure": 14, "figcaption": 14}
_BAD_TAGS = {7, 9, 10, 11}
_GOOD_TAGS = {5, 6}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNQUOTED = re.compile(r"""=\s*[^\s"'][^\s]*\Z""")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_BLANK = re.compile(r"[\x20\x09-\x0D]+")
_SENTENCE = re.compile(r"[.!?](?:\s|$)")


class Page:
    """Nodes (in document order, so a parent comes before its children) and text blocks of a page."""

    __slots__ = ("parent", "tag", "hints", "block_node", "block_text", "block_links")

    def __init__(self, source: str):
        self.parent, self.tag, self.hints = [-1], [15], [0]
        self.block_node, self.block_text, self.block_links = [], [], []
        stack, names = [0], ["#"]
        parts: list[str] = []
        links = 0
        in_link = 0
        dropped: list[str] = []
        at = 0

        def text(a, b):
            nonlocal links
            if dropped == ["head"] and source[a:b].strip():
                dropped.clear()
            if b > a and not dropped:
                piece = source[a:b]
                parts.append(piece)
                if in_link:
                    links += b - a

        def flush():
            nonlocal links
            if parts:
                got = _BLANK.sub(" ", html.unescape("".join(parts))).strip(" ")
                if got:
                    self.block_node.append(stack[-1])
                    self.block_text.append(got)
                    self.block_links.append(links)
                parts.clear()
            links = 0

        def pop_to(depth):
            flush()
            del stack[depth:], names[depth:]

        for m in iter(lambda: _TOKEN.search(source, at), None):
            text(at, m.start())
            at = m.end()
            name = m[2] or m[6]
            if name is None or not (m[4] or m[8]):
                continue
            name = name.lower()
            closing = m[1] or m[5]
            attrs = (m[3] if m[2] else m[7]) or ""
            empty = name in FOREIGN and attrs.endswith("/") and not _UNQUOTED.search(attrs)
            if "head" in dropped and (name == "body" or closing and name in ("head", "html")):
                dropped.clear()  # a body ends an open head
                if name == "head":
                    continue
            elif dropped == ["head"]:
                if closing:
                    continue
                if name not in IN_HEAD:
                    dropped.clear()
                elif name not in RAW:
                    if name in DROPPED and name != "head":
                        dropped.append(name)
                    continue
            elif dropped:
                if name == dropped[-1]:
                    if closing:
                        dropped.pop()
                    elif not empty:
                        dropped.append(name)
                    continue
                if name == "body" and not closing:
                    dropped.clear()
                else:
                    continue
            if closing:
                if name in BLOCKS:
                    if name in names:
                        pop_to(len(names) - 1 - names[::-1].index(name))
                    else:
                        flush()
                elif name == "a":
                    in_link = 0
                elif name in APART:
                    parts.append(" ")
                continue
            if name in RAW:
                end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
                if end is None:
                    at = len(source)
                else:
                    close = source.find(">", end.start())
                    at = len(source) if close < 0 else close + 1
                continue
            if name in DROPPED:
                if not empty:
                    dropped.append(name)
            elif name == "br" or name in APART:
                parts.append(" ")
            elif name == "hr":
                flush()
            elif name == "a":
                in_link = 1
            elif name in BLOCKS:
                flush()
                if name in SIBLINGS:
                    kinds, limits = SIBLINGS[name]
                    for k in range(len(names) - 1, 0, -1):
                        if names[k] in limits:
                            break
                        if names[k] in kinds:
                            pop_to(k)
                            break
                if name in CLOSES_P and names[-1] == "p":
                    pop_to(len(names) - 1)
                hint = 0
                if attrs:
                    for _, x, y, z in _ATTR.findall(attrs):
                        for w in _WORDS.findall(_CAMEL.sub(r"\1 \2", x or y or z).lower()):
                            if w in _HINT:
                                hint |= 1 << _HINT[w]
                if name in ("html", "body") and name in names:
                    continue
                self.parent.append(stack[-1])
                self.tag.append(_TAG.get(name, 15))
                self.hints.append(hint)
                stack.append(len(self.parent) - 1)
                names.append(name)
        text(at, len(source))
        flush()


FEATURES = len(_KINDS) + 2 * len(HINTS) + 3 + 14


def features(page: Page) -> np.ndarray:
    """A row for each node of the page."""
    parent, tag, hints = np.array(page.parent), np.array(page.tag), np.array(page.hints)
    n = len(parent)
    chars, links, blocks, ends, words = (np.zeros(n) for _ in range(5))
    for v, t, k in zip(page.block_node, page.block_text, page.block_links, strict=True):
        chars[v] += len(t)
        links[v] += min(k, len(t))
        blocks[v] += 1
        ends[v] += len(_SENTENCE.findall(t))
        words[v] += t.count(" ") + 1
    own = chars.copy()
    before = np.cumsum(own) - own
    depth, above_hints, above_bad, above_good = (np.zeros(n, np.int64) for _ in range(4))
    children, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    bad, good = np.isin(tag, list(_BAD_TAGS)), np.isin(tag, list(_GOOD_TAGS))
    nodes = np.ones(n)
    for v in range(1, n):
        p = parent[v]
        depth[v] = depth[p] + 1
        above_hints[v] = above_hints[p] | hints[p]
        above_bad[v] = above_bad[p] | bad[p]
        above_good[v] = above_good[p] | good[p]
        place[v] = children[p]
        children[p] += 1
    totals = np.stack((chars, links, blocks, ends, words, nodes))
    for v in range(n - 1, 0, -1):
        totals[:, parent[v]] += totals[:, v]
    chars, links, blocks, ends, words, nodes = totals
    sisters = children[np.maximum(parent, 0)]
    all_chars = max(chars[0], 1.0)
    hint_bits = [(hints >> i) & 1 for i in range(len(HINTS))]
    above_bits = [(above_hints >> i) & 1 for i in range(len(HINTS))]
    columns = [tag == i for i in range(len(_KINDS))] + hint_bits + above_bits + [
        above_bad, above_good, depth,
        np.log1p(chars), np.log1p(own), links / np.maximum(chars, 1), nodes, chars / nodes, ends / np.maximum(words, 1) * 10, np.log1p(words / np.maximum(blocks, 1)),
        sisters, place / np.maximum(sisters - 1, 1), chars / all_chars, chars / np.maximum(chars[np.maximum(parent, 0)], 1), before / all_chars, np.log1p(ends), blocks,
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


def decoded(page: Page, logit: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest choice in which all ancestors of a kept node are kept."""
    parent = page.parent
    gain = logit.tolist()
    gain[0] = max(gain[0], 0.0)  # what holds the whole page needs no merit of its own
    for v in range(len(gain) - 1, 0, -1):
        if gain[v] > 0:
            gain[parent[v]] += gain[v]
    keep = np.zeros(len(gain), bool)
    keep[0] = gain[0] > 0
    for v in range(1, len(gain)):
        keep[v] = keep[parent[v]] and gain[v] > 0
    return keep


# ---- generated pages ---------------------------------------------------------


class _Writer:
    """A random page with <x-main> marks around what belongs to the main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice("abcdefghijklmnoprstuvwxyzäéñü") for _ in range(self.r.randint(1, 3))) for _ in range(60)]

    def words(self, low, high):
        return " ".join("".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 3))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low, high):
        return " ".join(self.words(2, 18).capitalize() + self.r.choice([".", ".", ".", "!", "?"]) for _ in range(self.r.randint(low, high)))

    def link(self, low=1, high=4):
        return f'<a href="/{self.words(1, 1)}">{self.words(low, high)}</a>'

    def maybe(self, chance, make):
        return make() if self.r.random() < chance else ""

    def wrap(self, tags, hint, inner, plain=0.15):
        """In one of the tags; a div gets a class or id of the kind."""
        tag = self.r.choice(tags)
        word = self.r.choice(HINTS[hint].split())
        name = self.r.choice([word, f"{word}-{self.words(1, 1)}", f"site_{word}", f"{word} {self.words(1, 1)}"])
        attr = f' {self.r.choice(["class", "class", "id"])}="{name}"' if (tag == "div" or self.r.random() < 0.5) and not (tag != "div" and self.r.random() < plain) else ""
        if hint == "advert" and self.r.random() < 0.4:
            attr = ' class="ad"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(self, low, high):
        close = self.r.choice(["</li>", "</li>", ""])
        return "<ul>" + "".join(f"<li>{self.link()}{close}" for _ in range(self.r.randint(low, high))) + "</ul>"

    def menu(self):
        inner = self.links(3, 9) if self.r.random() < 0.7 else " | ".join(self.link() for _ in range(self.r.randint(2, 7)))
        return self.wrap(["nav", "nav", "div"], "menu", inner)

    def header(self):
        return self.wrap(["header", "div"], "menu", self.r.choice([f"<h1>{self.link()}</h1>", f"<p>{self.words(1, 6)}</p>", self.words(1, 5)]) + self.maybe(0.6, self.menu))

    def footer(self):
        inner = self.r.choice(["&copy; ", "Copyright ", ""]) + self.words(1, 4) + " &middot; " + self.sentences(0, 3)
        return self.wrap(["footer", "footer", "div"], "foot", self.r.choice([inner, f"<p>{inner}</p>" + self.maybe(0.5, lambda: self.links(2, 6))]))

    def advert(self):
        return self.wrap(["div", "div", "aside", "section"], "advert", self.r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 2)}</p>", self.link(2, 8)]), 0)

    def notice(self):
        return self.wrap(["div", "section", "dialog"], "notice", f"<p>{self.sentences(1, 3)}</p>" + self.maybe(0.5, lambda: f"<button>{self.words(1, 2)}</button>"), 0)

    def side(self):
        inner = self.r.choice([f"<h3>{self.words(1, 4)}</h3>" + self.links(2, 8), f"<h2>{self.words(1, 3)}</h2><p>{self.sentences(1, 4)}</p>", f"<p>{self.sentences(1, 5)}</p>"])
        return self.wrap(["aside", "aside", "div"], "side", inner)

    def form(self):
        return self.wrap(["form", "form", "div"], "form", f"<form><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button></form>" + self.maybe(0.4, lambda: f"<p>{self.sentences(1, 2)}</p>"))

    def comments(self):
        item = lambda: self.r.choice([f"<li><b>{self.words(1, 2)}</b><p>{self.sentences(1, 5)}</p></li>", f'<div class="comment"><p>{self.words(1, 2)}</p><p>{self.sentences(1, 6)}</p></div>', f"<article><h4>{self.words(1, 2)}</h4><p>{self.sentences(1, 5)}</p></article>"])
        items = "".join(item() for _ in range(self.r.randint(1, 6)))
        return self.wrap(["section", "div", "ol"], "comment", f"<h3>{self.words(1, 3)}</h3>" + items + self.maybe(0.4, self.form), 0)

    def paragraph(self):
        open_, close = self.r.choice([("<p>", "</p>"), ("<p>", "</p>"), ("<p>", ""), ("<p><b>", "<br>")])
        inner = self.sentences(1, self.r.choice([1, 2, 9]))
        if self.r.random() < 0.3:
            inner += f" {self.link()} " + self.sentences(1, 2)
        return open_ + inner + self.maybe(0.1, lambda: "<br>" + self.sentences(1, 1)) + close

    def article(self):
        title = f"<h1>{self.words(1, 12)}</h1>"
        parts = [self.r.choice([title, title, f"<header>{title}</header>", ""])]
        for _ in range(self.r.choice([1, 1, 2, 3, 5, 9, 16])):
            parts.append(self.paragraph())
            parts.append(self.maybe(0.12, lambda: f"<h2>{self.words(1, 6)}</h2>"))
            parts.append(self.maybe(0.06, lambda: "<ul>" + "".join(f"<li>{self.words(2, 14)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"))
            parts.append(self.maybe(0.05, lambda: f"<blockquote>{self.r.choice(['', '<p>'])}{self.sentences(1, 3)}</blockquote>"))
            parts.append(self.maybe(0.03, lambda: f"<pre>{self.words(4, 20)}</pre>"))
            parts.append(self.maybe(0.03, lambda: f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>"))
            parts.append(self.maybe(0.05, lambda: self.off(self.r.choice([self.advert, self.side, self.form])())))
        parts.append(self.maybe(0.12, lambda: self.off(f"<footer>{self.words(1, 6)}</footer>")))
        inner = "".join(parts)
        kind = self.r.random()
        if kind < 0.14:
            return inner
        if kind < 0.55:
            return f"<article>{inner}</article>"
        if kind < 0.7:
            return f"<main><article>{inner}</article></main>"
        if kind < 0.8:
            return f"<main>{inner}</main>"
        return self.wrap(["div", "section", "div"], "body", inner, 0)

    def off(self, inner):
        return f"</x-main>{inner}<x-main>"

    def page(self):
        r = self.r
        before = [self.maybe(0.3, self.notice), self.maybe(0.4, self.header), self.maybe(0.8, self.menu), self.maybe(0.25, self.form), self.maybe(0.25, self.side), self.maybe(0.6, self.advert)]
        after = [self.maybe(0.25, self.advert), self.maybe(0.3, self.comments), self.maybe(0.35, self.side), self.maybe(0.2, self.form), self.maybe(0.1, self.notice), self.maybe(0.85, self.footer)]
        if r.random() < 0.4:
            r.shuffle(before)
        body = "".join(before) + f"<x-main>{self.article()}</x-main>" + "".join(after)
        if r.random() < 0.15:
            body = f'<div id="{r.choice(["wrap", "page", "container"])}">{body}</div>'
        out = f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title></head><body>{body}</body></html>"
        if r.random() < 0.08:
            cut = out.rfind("<p") + r.randint(0, 40)
            out = out[: max(cut, 200)]
        return out


def labelled_page(seed: int) -> tuple[Page, np.ndarray]:
    """A generated page and which of its nodes hold, in themselves or below, some of the main text."""
    source = _Writer(seed).page()
    # Marks are characters of no text: on where the main text begins, off where it ends.
    marked = re.sub(r"<(/?)x-main>", lambda m: "\ue001" if m[1] else "\ue000", source)
    page = Page(re.sub("[\ue000\ue001]", "", marked))
    # Text between marks gets a sign at its head; a second reading tells which blocks have it.
    on, out = False, []
    for piece in re.split("([\ue000\ue001]|<[^>]*>)", marked):
        if piece in ("\ue000", "\ue001"):
            on = piece == "\ue000"
        else:
            out.append("\ue002" + piece if on and piece and piece[0] != "<" and piece.strip() else piece)
    signed = Page("".join(out))
    y = np.zeros(len(page.parent), bool)
    for v, t in zip(signed.block_node, signed.block_text, strict=True):
        if "\ue002" in t and v < len(y):
            y[v] = True
    for v in range(len(y) - 1, 0, -1):
        if y[v]:
            y[page.parent[v]] = True
    return page, y


_MODEL: list[BoostedTrees] = []


def fit(pages: int = PAGES) -> BoostedTrees:
    """The trees; fitted once a process."""
    if not _MODEL:
        got = [labelled_page(s) for s in range(pages)]
        x, y = np.concatenate([features(p) for p, _ in got]), np.concatenate([y for _, y in got])
        _MODEL.append(BoostedTrees(trees=80, depth=5).fit(x, y.astype(float)))
    return _MODEL[0]


def main_texts(sources: list[str], model: BoostedTrees) -> list[str]:
    pages = [Page(s) for s in sources]
    rows = [features(p) for p in pages]
    logit = model.logit(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for p, x in zip(pages, rows, strict=True):
        keep = decoded(p, logit[at : at + len(x)])
        at += len(x)
        out.append("\n\n".join(t for v, t in zip(p.block_node, p.block_text, strict=True) if keep[v]))
    return out


def extracted(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(model or fit())

    @C.tidy
    def run(batches):
        for batch in C.small_batches(batches, "html", C.CHUNK_BYTES // 2, 512):
            texts = main_texts([s or "" for s in batch.column("html").to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; odd rows as the module says."""
    return extracted(C.table(spark, sf_dir, "pages", "page_id", "url", "html"))
