"""Main-text extraction by gradient-boosted trees over DOM nodes.

Method: a page is parsed leniently into block nodes. Each node has features of its
subtree (text and link density, punctuation), its tag and attribute tokens, its
depth, its place in the page and among its siblings, and what its ancestors'
tokens say. Boosted regression trees give the probability that the node's text is
main text. Hierarchical decoding then chooses states for all nodes together by
dynamic programming: a node is inside (so are its descendants), outside (so are
they) or mixed (its children decide), so no choice contradicts an ancestor's.

The trees are trained here, on pages that `training_page` makes up from seeds: a
bounded sample whose size is the parameter `n_pages`; no page of the input is used.

Text: character references are decoded; white space within a block becomes one
space, also for `br`; blocks are joined in page order by a line end. Scripts,
styles, titles, forms' fields, comments in the markup and other elements without text
for readers are never text. Nothing else is dropped or capped.

Defined results: a null or empty page, or one without main text, gives the empty
text. A head ends with its end tag or at the first thing that can't stand in it.
Tags are read by the attribute states of the HTML standard, each once; a tag cut off by
the page's end is no text. Unclosed and stray tags are repaired as browsers do, at any
depth. Very long pages are read whole, in time in proportion to their length. Repeated rows
get the same text each. Input columns are kept; own columns replace columns of the same
name. Empty tables give empty results.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ridgeline.llm import textkit
from ridgeline.llm.lineage import kept_and

TRAIN_PAGES, TREES, DEPTH, BINS, SHRINK = 500, 50, 4, 32, 0.25
MIXED_COST = 0.7
_S = "[\t\n\f\r ]"
#: A tag by the tokenizer states of the HTML standard: name, then attributes of which each is a name and perhaps a double-quoted,
#: single-quoted or unquoted value. Quantifiers never give back, so a tag is read once. A quote that nothing closes is part of an unquoted value.
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{_S}*+={_S}*+(?>\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >]++)?+)?+)*+)>")
_COMMENT_END = re.compile("--!?>")
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "video", "audio", "textarea", "select", "title"}
#: Of these, the ones whose content runs to the end of the page if nothing ends it; after the others the page goes on.
_TO_THE_END = {"script", "style", "template", "iframe", "textarea"}
#: Void elements that may stand in the head without ending it.
_IN_HEAD = {"base", "link", "meta"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {
    "html", "body", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption",
    "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "fieldset", "figure", "figcaption", "blockquote", "pre", "address", "details",
    "summary", "menu", "dialog", "hgroup", "search", "center", "button", "label",
}
#: A start tag of the key ends open elements of these kinds, up to the nearest other block.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_KINDS = ("p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol menu dl", "li dt dd", "table thead tbody tfoot tr td th caption", "div center", "section", "article", "main", "header", "footer", "nav", "aside", "form fieldset button label search", "figure figcaption", "blockquote pre", "details summary dialog", "address")
_KIND = {t: i for i, names in enumerate(_KINDS) for t in names.split()}
#: Words of classes, ids and roles, by what they say of a block.
_WORDS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs toolbar links sitemap",
    "head": "header head masthead topbar top branding logo hero",
    "foot": "footer foot bottom copyright legal colophon imprint contentinfo",
    "side": "sidebar side aside rail widget widgets complementary left right column secondary related recommended recommend popular trending more teaser",
    "note": "notice cookie cookies consent banner alert popup modal overlay gdpr privacy warning toast paywall",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted adsense dfp affiliate shopping",
    "form": "form login signup search subscribe newsletter register contact input signin",
    "talk": "comment comments commentlist reply replies respond disqus discussion reader readers review reviews reaction reactions",
    "share": "share sharing social follow like tweet facebook meta byline author tags tag bio date print",
    "good": "article content main post entry story body text page copy prose longform paragraph articlebody maincontent",
}
_WORD = {w: i for i, words in enumerate(_WORDS.values()) for w in words.split()}
_N_WORDS = len(_WORDS)
#: One attribute of a tag, as in _TAG: name, and the value in one of three groups.
_ATTR = re.compile(rf"([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:{_S}*+={_S}*+(?>\"([^\"]*+)\"|'([^']*+)'|([^\t\n\f\r >]++))?+)?+")
_NAMING = {"class", "id", "role", "itemprop", "aria-label", "data-component"}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


class Page:
    """Block nodes in page order (parents first) and their text runs."""

    __slots__ = ("kind", "words", "parent", "depth", "tags", "runs", "links", "hidden")

    def __init__(self):
        self.kind, self.words, self.parent, self.depth, self.tags, self.links, self.hidden = [], [], [], [], [], [], []
        self.runs: list[tuple[int, str]] = []  # node, text


@functools.lru_cache(maxsize=20_000)
def _tokens(attrs: str) -> tuple[int, bool]:
    """Which word groups the attributes name (bits), and whether they hide the element."""
    bits, hidden = 0, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in _NAMING:
            for w in _PART.findall(value):
                if (i := _WORD.get(w.lower())) is not None:
                    bits |= 1 << i
        hidden = hidden or name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and bool(_NOT_SHOWN.search(value)))
    return bits, hidden


def tokens(source: str) -> Generator[tuple[int, int, re.Match | None], int | None, None]:
    """The markup of a page in order: begin, end, and the match of a tag (None for a comment and the like). What lies between is text.

    A generator that takes the place to go on from, where the reader skips raw text.
    """
    at, n = 0, len(source)
    while (at := source.find("<", at)) >= 0:
        follows = source[at + 1 : at + 3]
        m, end = None, n
        if source.startswith("<!--", at):
            if source.startswith((">", "->"), at + 4):  # the empty comment
                end = source.index(">", at) + 1
            elif found := _COMMENT_END.search(source, at + 4):
                end = found.end()
        elif follows[:1] in ("!", "?") or (follows[:1] == "/" and len(follows) == 2 and not (follows[1].isascii() and follows[1].isalpha())):
            end = source.find(">", at) + 1 or n
        elif m := _TAG.match(source, at):
            end = m.end()
        elif not (follows.lstrip("/")[:1].isascii() and follows.lstrip("/")[:1].isalpha()):  # a sign in the text
            at += 1
            continue
        # a tag that the page's end cuts off is no text, as in browsers
        went_on = yield at, end, m
        at = end if went_on is None else went_on


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int, Counter]] = []  # open blocks, their nodes and open inline elements
    opened: Counter = Counter()  # open blocks by tag
    pending: list[str] = []
    in_link = 0
    in_head = False
    never_ended: set[str] = set()  # raw elements without an end tag from here on

    def open_node(tag: str, attrs: str, parent: int) -> int:
        bits, hidden = _tokens(attrs) if attrs else (0, False)
        page.kind.append(_KIND.get(tag, -1))
        page.words.append(bits)
        page.parent.append(parent)
        page.depth.append(page.depth[parent] + 1 if parent >= 0 else 0)
        page.tags.append(0)
        page.links.append(0)
        page.hidden.append(hidden)
        return len(page.kind) - 1

    root = open_node("body", "", -1)
    loose: Counter = Counter()  # inline elements outside all blocks

    def here() -> int:
        return stack[-1][1] if stack else root

    def close() -> str:
        nonlocal in_link
        tag, _, inline = stack.pop()
        opened[tag] -= 1
        in_link -= inline["a"]
        return tag

    def flush() -> None:
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                page.runs.append((here(), text))

    def text(raw: str) -> None:
        if raw:
            pending.append(raw)
            if in_link:
                page.links[here()] += len(raw)

    before, n = 0, len(source)
    reader = tokens(source)
    token = next(reader, None)
    while token is not None:
        begin, at, m = token
        raw = source[before:begin]
        text(raw)
        in_head = in_head and not raw.strip()
        before, skip = at, None
        tag = m[2].lower() if m else None
        if tag is None:
            pass
        elif m[1]:  # an end tag
            in_head = in_head and tag != "head"
            inline = stack[-1][2] if stack else loose
            if tag == "br":
                pending.append(" ")
            elif tag in _BLOCKS:
                if opened[tag]:
                    flush()
                    while close() != tag:
                        pass
            elif inline[tag]:  # it ends no block
                inline[tag] -= 1
                in_link -= tag == "a"
        elif tag == "head":
            in_head = True
        elif in_head and tag in _IN_HEAD:
            pass
        elif tag in _VOID:
            in_head = False
            page.tags[here()] += 1
            if tag == "hr":
                flush()
            elif tag == "br":
                pending.append(" ")
        elif tag in _RAW:
            if not m[3].rstrip().endswith("/"):
                # an open title must not take the head's end along
                pattern = rf"</{tag}(?=[\t\n\f\r />])[^>]*+>" + (r"|(?=</head\s*>|<body[\s>])" if tag == "title" else "")
                end = None if tag in never_ended else re.compile(pattern, re.I).search(source, at)
                if end is not None:
                    skip = end.end()
                else:
                    never_ended.add(tag)
                    if tag in _TO_THE_END:
                        skip = n
                    elif tag == "title":
                        skip = max(source.find("<", at), at)
        else:
            in_head = False
            if tag in _BLOCKS:
                flush()
                ends = _ENDS.get(tag, {"p"})
                while stack and stack[-1][0] in ends:
                    close()
                if tag not in ("html", "body"):
                    page.tags[here()] += 1
                    stack.append((tag, open_node(tag, m[3], here()), Counter()))
                    opened[tag] += 1
            else:
                page.tags[here()] += 1
                (stack[-1][2] if stack else loose)[tag] += 1
                in_link += tag == "a"
        if skip is not None:
            before = skip
        try:
            token = reader.send(skip)
        except StopIteration:
            token = None
    text(source[before:])
    flush()
    return page


def node_features(page: Page) -> np.ndarray:
    """One row per node."""
    n = len(page.kind)
    parent = np.array(page.parent, np.int64)
    own = np.zeros(n)
    marks = np.zeros(n)
    runs = np.zeros(n)
    place = np.full(n, np.inf)
    total = 0
    for node, text in page.runs:
        own[node] += len(text)
        marks[node] += text.count(".") + text.count(",") + text.count(";")
        runs[node] += 1
        place[node] = min(place[node], total)
        total += len(text)
    links = np.minimum(np.array(page.links, float), own)
    tags = np.array(page.tags, float)
    sub = np.stack([own, links, tags, marks, runs], axis=1)
    first = place.copy()
    size = np.ones(n)
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = page.parent[i]
        sub[p] += sub[i]
        size[p] += size[i]
        if first[i] < first[p]:
            first[p] = first[i]
    kind = np.array(page.kind, np.int64)
    words = np.array(page.words, np.int64)
    above_words, above_kind = words.copy(), np.where(kind >= 0, np.int64(1) << np.maximum(kind, 0), 0)
    index, count = np.zeros(n), np.zeros(n)
    same: dict[tuple[int, int], int] = {}
    for i in range(1, n):
        p = page.parent[i]
        above_words[i] |= above_words[p]
        above_kind[i] |= above_kind[p]
        index[i] = count[p]
        count[p] += 1
        same[(p, page.kind[i])] = same.get((p, page.kind[i]), 0) + 1
    alike = np.array([same.get((p, k), 1) for p, k in zip(page.parent, page.kind, strict=True)], float)
    total = max(total, 1)
    pp = np.maximum(parent, 0)
    length = sub[:, 0]
    bit = lambda flags, i: (flags >> i & 1).astype(float)
    columns = [
        np.log1p(length), sub[:, 1] / np.maximum(length, 1), length / (1 + sub[:, 2]), sub[:, 3] / np.maximum(length, 1) * 50, length / total,
        np.where(np.isinf(first), 1, first / total), np.array(page.depth, float), index, count[pp], alike, np.log1p(size), np.log1p(own), length / np.maximum(sub[:, 4], 1),
        sub[pp, 0] / total, sub[pp, 1] / np.maximum(sub[pp, 0], 1), length / np.maximum(sub[pp, 0], 1), np.array(page.hidden, float),
        *(bit(words, i) for i in range(_N_WORDS)), *(bit(above_words, i) for i in range(_N_WORDS)),
        *((kind == i).astype(float) for i in range(len(_KINDS))), *(bit(above_kind, i) for i in (2, 4, 7, 8, 9, 10, 11, 12, 13, 16)),
    ]
    return np.stack(columns, axis=1)


class Trees:
    """Boosted regression trees on the logistic loss; complete trees of one depth, splits on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        rate = y.mean()
        self.base, self.depth = float(np.log(rate / (1 - rate))), depth
        z = np.full(len(y), self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_f = x.shape[1]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            features, cuts = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
            for level in range(depth):
                width = 2**level
                best = np.full(width, 1e-6)
                for f in range(n_f):
                    if not len(self.edges[f]):
                        continue
                    key = node * BINS + b[:, f]
                    gs = np.bincount(key, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    hs = np.bincount(key, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                    gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    features[width - 1 + np.flatnonzero(better)] = f
                    cuts[width - 1 + np.flatnonzero(better)] = at[better]
                here = width - 1 + node
                node = node * 2 + (b[np.arange(len(y)), features[here]] > cuts[here])
            gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
            leaves = SHRINK * gs / (hs + 1)
            z += leaves[node]
            self.trees.append((features, cuts, leaves))

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        rows, z = np.arange(len(x)), np.full(len(x), self.base)
        for features, cuts, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                here = 2**level - 1 + node
                node = node * 2 + (b[rows, features[here]] > cuts[here])
            z += leaves[node]
        return z


def decode(page: Page, z: np.ndarray) -> list[bool]:
    """For each node whether its own text is inside. z: log odds of main text."""
    n = len(page.kind)
    yes = -np.logaddexp(0, -z)
    no = -np.logaddexp(0, z)
    inside, outside = yes.tolist(), no.tolist()
    mixed = [-MIXED_COST] * n
    own = np.zeros(n, bool)
    for node, _ in page.runs:
        own[node] = True
    for i in range(n):
        if own[i]:
            mixed[i] += max(yes[i], no[i])
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        inside[p] += inside[i]
        outside[p] += outside[i]
        mixed[p] += max(inside[i], outside[i], mixed[i])
    state = [0] * n  # 1 inside, 0 outside, 2 mixed
    for i in range(n):
        above = state[page.parent[i]] if i else 2
        if above < 2:
            state[i] = above
        else:
            best = max(inside[i], outside[i], mixed[i])
            state[i] = 1 if inside[i] == best else 0 if outside[i] == best else 2
    return [s == 1 or (s == 2 and zi > 0) for s, zi in zip(state, z.tolist(), strict=True)]


def main_text(pages: list[str | None], trees: Trees) -> list[str]:
    parsed = [parse(p) if p else None for p in pages]
    full = [p for p in parsed if p is not None]
    if not full:
        return [""] * len(pages)
    z = trees.log_odds(np.concatenate([node_features(p) for p in full]))
    out, at = [], 0
    for p in parsed:
        if p is None:
            out.append("")
            continue
        chosen = decode(p, z[at : at + len(p.kind)])
        at += len(p.kind)
        out.append("\n".join(t for node, t in p.runs if chosen[node]))
    return out


# training pages


def training_page(seed: int) -> tuple[str, list[str]]:
    """A made-up page and the blocks of its main text, in order."""
    r = np.random.default_rng(seed)
    pick = lambda *x: x[int(r.integers(len(x)))]
    chance = lambda p: bool(r.random() < p)
    parts = ["ka", "lo", "min", "ter", "us", "ing", "ou", "the", "re", "él", "sch", "ö", "ra", "si", "po", "ción", "ten", "er", "vu"]

    def word() -> str:
        return "".join(parts[int(i)] for i in r.integers(len(parts), size=int(r.integers(1, 5))))

    def sentence(lo: int, hi: int) -> str:
        words = [word() for _ in range(int(r.integers(lo, hi + 1)))]
        return (" ".join(w + "," * chance(0.1) for w in words[:-1]) + " " + words[-1]).strip().capitalize() + "."

    def prose(most: int) -> str:
        return " ".join(sentence(1, 18) for _ in range(int(r.integers(1, most + 1))))

    def box(tags: tuple[str, ...], names: tuple[str, ...], inner: str, named: float = 0.75) -> str:
        tag = pick(*tags)
        attr = f' {pick("class", "id")}="{pick("", "", "site-", "c-", "js ")}{pick(*names)}{pick("", "", "-inner", " wide", "-1")}"' if chance(named) else ""
        return f"<{tag}{attr}>{inner}</{tag}>"

    def links(n: int) -> str:
        items = [f'<a href="/{word()}">{" ".join(word() for _ in range(int(r.integers(1, 4))))}</a>' for _ in range(n)]
        return pick("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " | ".join(items), "".join(f"<div>{i}</div>" for i in items))

    def boiler(kind: str) -> str:
        n = int(r.integers(2, 9))
        if kind == "menu":
            return box(pick(("nav",), ("div", "ul")), ("nav", "menu", "navbar", "navigation", "breadcrumb"), links(n), 0.6) if chance(0.7) else "<nav>" + links(n) + "</nav>"
        if kind == "head":
            return box(("header", "div"), ("header", "masthead", "topbar"), f"<{pick('div', 'h1', 'p')}>{sentence(1, 5)}</{pick('div', 'h1', 'p')}>" + (links(n) if chance(0.5) else ""))
        if kind == "foot":
            return box(("footer", "div", "footer"), ("footer", "copyright", "bottom"), pick("&copy; ", "") + pick(f"www.{word()}.example &middot; ", "") + pick(prose(3), f"<p>{prose(3)}</p>", links(n)))
        if kind == "side":
            return box(("aside", "div"), ("sidebar", "widget", "related", "popular"), f"<h3>{sentence(1, 4)}</h3>" + pick(links(n), f"<p>{prose(3)}</p>" * 1, links(n) + f"<p>{prose(2)}</p>"))
        if kind == "note":
            return box(("div", "section"), ("cookie", "notice", "banner", "consent", "alert", "popup"), pick(prose(2), f"<p>{prose(3)}</p><button>{word()}</button>"), 1)
        if kind == "ad":
            return pick(f"<!-- ad {n} -->", "") + box(("div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo", "advertisement"), pick(prose(3), f"<p>{prose(2)}</p>", f"<a href='/x'>{prose(2)}</a>"), 1)
        if kind == "form":
            return box(("form",), ("search", "login", "newsletter", "subscribe"), f"<label>{sentence(1, 4)}</label><input name=q>" + pick("", f"<p>{prose(2)}</p>") + f"<button>{word()}</button>", 0.6)
        if kind == "talk":
            item = lambda: box(("div", "li", "article"), ("comment", "reply", "review"), pick("", f"<b>{word()}</b> ") + f"<p>{prose(4)}</p>", 0.7)
            return box(("section", "div", "ol"), ("comments", "discussion", "respond", "replies", "reviews"), f"<h3>{sentence(1, 3)}</h3>" + "".join(item() for _ in range(int(r.integers(1, 6)))), 1)
        return box(("div", "p", "ul"), ("share", "social", "meta", "byline", "tags"), links(int(r.integers(2, 5))), 1)

    blocks: list[str] = []

    def block(text: str) -> str:
        blocks.append(" ".join(text.split()))
        return text

    def paragraph() -> str:
        text = block(prose(pick(1, 2, 6)) if chance(0.9) else word().capitalize() + ".")
        style = int(r.integers(7))
        if style == 0:
            return f"<p><b>{text}<br>"  # unclosed
        if style == 1 and " " in text:
            a, b = text.split(" ", 1)
            return f'<p><a href="/{word()}">{a}</a> {b}</p>'
        return f"<p>{text}</p>" if style < 6 else f"<p><em>{text}</em></p>"

    body = [f"<{(h := pick('h1', 'h1', 'h2'))}>{block(sentence(2, 9))}</{h}>"] * 1 if chance(0.9) else []
    for _ in range(int(r.integers(0, pick(3, 8, 25)))):
        kind = int(r.integers(14))
        if kind == 0:
            body.append("<ul>" + "".join(f"<li>{block(prose(2))}</li>" for _ in range(int(r.integers(1, 5)))) + "</ul>")
        elif kind == 1:
            body.append(f"<blockquote>{block(prose(3))}</blockquote>")
        elif kind == 2:
            body.append(f"<h{pick(2, 3)}>{block(sentence(1, 6))}</h{pick(2, 3)}>" if False else f"<h2>{block(sentence(1, 6))}</h2>")
        elif kind == 3 and chance(0.5):
            body.append("<table>" + "".join("<tr>" + "".join(f"<td>{block(sentence(1, 4))}</td>" for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
        elif kind == 4 and chance(0.6):
            body.append(boiler(pick("ad", "share", "note", "side", "form")))
        else:
            body.append(paragraph())
    wrap = int(r.integers(6))
    inner = "".join(body)
    if wrap <= 1:
        main = f"<article>{inner}</article>"
    elif wrap == 2:
        main = box(("div", "section", "main"), ("content", "article", "post", "entry", "story", "main"), inner, 1)
    elif wrap == 3:
        main = f"<main><div>{inner}</div></main>"
    elif wrap == 4:
        main = f'<div class="{pick("wrap", "x1", "container")}"><article class="post">{inner}</article></div>'
    else:
        main = f"<div>{inner}</div>"
    if not blocks:
        main = "<article></article>"
    before = [boiler(k) for k in ("menu", "head", "note", "ad", "form", "menu", "ad") if chance(0.4)]
    after = [boiler(k) for k in ("talk", "side", "share", "foot", "ad", "foot", "note") if chance(0.45)]
    if chance(0.2):  # a bare page
        before, after = [], []
    head = f"<!DOCTYPE html><html><head><title>{sentence(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if chance(0.9) else ""
    return head + "<body>" + "".join(before) + main + "".join(after) + ("</body></html>" if chance(0.9) else ""), blocks


@functools.lru_cache(maxsize=2)
def train(n_pages: int = TRAIN_PAGES) -> Trees:
    """Trees trained on the made-up pages 0 .. n_pages - 1."""
    xs, ys = [], []
    for seed in range(n_pages):
        source, blocks = training_page(seed)
        page = parse(source)
        left, n = list(blocks), len(page.kind)
        good, all_ = np.zeros(n), np.zeros(n)
        for node, text in page.runs:
            all_[node] += len(text)
            if left and left[0] == text:
                good[node] += len(text)
                left.pop(0)
        for i in range(n - 1, 0, -1):
            good[page.parent[i]] += good[i]
            all_[page.parent[i]] += all_[i]
        sel = all_ > 0
        xs.append(node_features(page)[sel])
        ys.append((good[sel] > 0.5 * all_[sel]).astype(float))
    return Trees(np.concatenate(xs), np.concatenate(ys))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", keep: list[str] | None = None, trees: Trees | None = None) -> DataFrame:
    """Add the main text of each whole page; no shuffle."""
    kept = [c for c in (pages.columns if keep is None else keep) if c != text_col]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField(text_col, T.StringType())])
    shared = pages.sparkSession.sparkContext.broadcast(trees or train())
    frame = kept_and(pages, kept, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = textkit.utf8(batch.column(len(kept)))
            for lo, hi in textkit.pieces(source, 1 << 20):
                texts = main_text(source.slice(lo, hi - lo).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(kept))] + [pa.array(texts, pa.string())], names=[*kept, text_col])

    return frame.mapInArrow(run, schema)
