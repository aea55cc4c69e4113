"""Main text of web pages: boosted trees over block nodes of the DOM, decoded so that no choice contradicts its ancestors.

Every block element of a page is a node with features: text and links below it, density, depth, place among its
siblings and how it compares with them, its tag, and words of its attributes. Boosted trees give the probability that a
node is main text. The trees learn from a bounded sample of the pages themselves: semantic landmarks (article, main
against nav, aside, footer, …) label the nodes, and rewritten copies of the sampled pages, in which landmarks are
renamed and further boilerplate is inserted, teach the trees to do without them. Decoding finds the most likely labelling of
the tree in which nothing below a boilerplate node is main text.
"""

from __future__ import annotations

import gc
import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that the trees are fitted on, at most, and the longest of them; rewritten copies of each.
SAMPLE, SAMPLE_CHARS, COPIES = 250, 60_000, 3
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32
#: Nodes that are classified together.
BATCH_NODES = 50_000

# Fixed values of the HTML standard: elements by kind.
BLOCK = frozenset("html body head title address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section select summary table caption tbody td tfoot th thead tr ul button label noscript".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Everything up to the end tag is no text of the page, or to the end of the page if there is none.
RAW = frozenset("script style template iframe textarea noframes".split())
# Start tags that end a drawing that was left open, as the standard has it.
LEAVES_SVG = BLOCK - {"title", "noscript"} | frozenset("b big br code em embed font i img listing meta nobr ruby s small span strong strike sub sup tt u var".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li".split())
SAME_ENDS = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CELLS = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}

# A comment, a declaration or a broken end tag; or the name of a tag. A `<` before anything else is text.
_MARKUP = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>?|/(?![a-zA-Z])[^>]*+>?|(/?)([a-zA-Z][^\s/>]*+))", re.S)
# The attributes of a tag and its end. A quote opens a value only behind an equals sign and only if it is closed; nothing is
# tried twice, so the time is linear whatever the tag looks like.
_REST = re.compile(r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?=>)|[^\s>\"'][^\s>]*+))?+)*+)>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[A-Za-z]+")

# Attribute words, by what they speak for.
TOKENS = {
    "body": "article content main post entry story text body blog news copy prose".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip topbar".split(),
    "frame": "header head footer foot masthead bottom copyright legal site brand logo".split(),
    "side": "aside sidebar side rail widget related recommended more links tags author bio share social".split(),
    "advert": "ad ads advert adverts advertisement banner sponsor sponsored promo promotion".split(),
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr privacy newsletter subscribe signup login".split(),
    "talk": "comment comments reply replies discussion respond disqus thread reader".split(),
}
GROUPS = {
    "landmark": {"article", "main"}, "wrapper": {"html", "body", "div", "section", "center"}, "head": {"head", "title"},
    "nav": {"nav", "menu", "search"}, "aside": {"aside"}, "edge": {"header", "footer"}, "form": {"form", "fieldset", "select", "option", "button", "label", "legend", "optgroup"},
    "paragraph": {"p", "blockquote", "pre"}, "heading": {"h1", "h2", "h3", "h4", "h5", "h6"}, "list": {"ul", "ol", "dl"}, "item": {"li", "dd", "dt"}, "table": {"table", "tr", "td", "th", "tbody", "thead"},
}
_OF_TOKEN = {w: g for g, words in TOKENS.items() for w in words}


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    attributes: str = ""
    chars: int = 0
    links: int = 0
    tags: int = 0
    stops: int = 0
    paragraphs: int = 0
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str]]


_END_TAGS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
#: Elements that keep a paragraph outside of them open.
_KEEPS_P = ("td", "th", "table", "button")


class _Open:
    """Stack of open elements that knows at which depths each name is open, so that no step looks through the stack."""

    def __init__(self) -> None:
        self.nodes, self.names, self._depths = [0], [""], {}

    def last(self, *names: str) -> int:
        """Depth of the innermost open element of these names; 0 if none is open."""
        found = 0
        for name in names:
            depths = self._depths.get(name)
            if depths and depths[-1] > found:
                found = depths[-1]
        return found

    def push(self, name: str, node: int) -> None:
        self._depths.setdefault(name, []).append(len(self.names))
        self.names.append(name)
        self.nodes.append(node)

    def cut(self, depth: int) -> None:
        while len(self.names) > depth:
            self._depths[self.names.pop()].pop()
            self.nodes.pop()


def parse(source: str | None) -> Page:
    """``read_page`` without the collector of cycles: a page of many nodes has none, and looking for them takes most of the time."""
    collecting = gc.isenabled()
    gc.disable()
    try:
        return read_page(source)
    finally:
        if collecting:
            gc.enable()


def read_page(source: str | None) -> Page:
    """Block nodes in page order (the first is the root) and text blocks, each with the node that holds it.

    Tags are read as the HTML standard reads them, but a quote that is never closed opens no value. A tag that the page
    ends in is dropped. Text of a drawing (svg) is no text of the page, but HTML inside its foreignObject is. A drawing that
    is left open ends at the next HTML element, or with its parent. Formulas, fallbacks of media and what is meant for readers
    without scripts are text like any other. The time is linear in the length of the page.
    """
    text = source or ""
    nodes, blocks, opened = [Node("", -1, 0)], [], _Open()
    run, linked, at = [], 0, 0
    # Open svg and foreignobject elements, and how many of each.
    drawn: list[str] = []
    drawings = {"svg": 0, "foreignobject": 0}
    # Names without a further end tag.
    endless: set[str] = set()

    def close_run() -> None:
        if run:
            joined = "".join(run)
            whole = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if whole:
                node = nodes[opened.nodes[-1]]
                node.chars += len(whole)
                node.stops += whole.count(".") + whole.count(",")
                blocks.append((opened.nodes[-1], whole))
            run.clear()

    def pop_to(depth: int) -> None:
        close_run()
        opened.cut(depth)

    def after(name: str, start: int) -> int | None:
        """Where the raw text of an element ends, None if it never does."""
        end = None if name in endless else _END_TAGS[name].search(text, start)
        if not end:
            endless.add(name)
        return end.end() if end else None

    while True:
        match = _MARKUP.search(text, at)
        piece = text[at:match.start()] if match else text[at:]
        if piece and not (drawn and drawn[-1] == "svg"):
            run.append(piece)
            if linked:
                nodes[opened.nodes[-1]].links += len(piece)
        if not match:
            break
        at = match.end()
        if not match[2]:
            continue
        rest = _REST.match(text, at)
        if not rest:
            break
        at = rest.end()
        ends, name = match[1], match[2].lower()
        if name == "svg" or drawn and name == "foreignobject":
            if not ends:
                if not rest[1].endswith("/"):
                    drawn.append(name)
                    drawings[name] += 1
            elif drawings[name]:
                closed = ""
                while closed != name:
                    closed = drawn.pop()
                    drawings[closed] -= 1
            continue
        if drawn and drawn[-1] == "svg":
            if not (opened.last(name) or name == "p" if ends else name in LEAVES_SVG):
                if name in RAW and not ends and not rest[1].endswith("/"):
                    at = after(name, at) or at
                continue
            drawn.clear()
            drawings = dict.fromkeys(drawings, 0)
        if ends:
            if name == "a":
                linked = 0
            elif name in BLOCK and opened.last(name):
                pop_to(opened.last(name))
            elif name == "p":
                close_run()
            continue
        if name in RAW:
            at = after(name, at) or len(text)
            continue
        nodes[opened.nodes[-1]].tags += 1
        if name == "br":
            run.append(" ")
        elif name == "a":
            linked = 1
        if name not in BLOCK:
            continue
        close_run()
        linked = 0
        if name in ENDS_P and opened.last("p") > opened.last(*_KEEPS_P):
            pop_to(opened.last("p"))
        if name in SAME_ENDS:
            cell = opened.last(*CELLS.get(name, (name,)))
            if cell > opened.last(*SAME_ENDS[name]):
                pop_to(cell)
        if name == "body" and opened.names[-1] in ("head", "title"):
            pop_to(opened.last("head") or len(opened.names) - 1)
        if name in VOID:
            continue
        node = Node(name, opened.nodes[-1], len(opened.nodes), rest[1])
        nodes[opened.nodes[-1]].children.append(len(nodes))
        opened.push(name, len(nodes))
        nodes.append(node)
    close_run()
    return Page(nodes, blocks)


def attribute_words(attributes: str) -> list[str]:
    return [w.lower() for m in _ATTRIBUTE.finditer(attributes) for v in m.groups()[1:] if v for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v))] if "=" in attributes else []


_GROUP_BITS = {tag: 1 << k for k, group in enumerate(GROUPS.values()) for tag in group}
_FLAGS = len(GROUPS) + len(TOKENS)
#: Counts of siblings and places beyond this say no more: a text may have hundreds of paragraphs.
MANY = 8


def _token_bits(attributes: str) -> int:
    # Only short attributes are worth a place in the cache.
    return _bits_of_short(attributes) if len(attributes) <= 1_000 else _bits(attributes)


def _bits(attributes: str) -> int:
    bits = 0
    for w in attribute_words(attributes):
        if w in _OF_TOKEN:
            bits |= 1 << (len(GROUPS) + list(TOKENS).index(_OF_TOKEN[w]))
    return bits


_bits_of_short = lru_cache(maxsize=20_000)(_bits)


def counts(page: Page) -> list[tuple]:
    """Plain numbers of every node: its own, those of the text below it, and its parent's."""
    nodes = page.nodes
    n = len(nodes)
    chars, links = [x.chars for x in nodes], [x.links for x in nodes]
    tags, stops, paragraphs = [x.tags for x in nodes], [x.stops for x in nodes], [1 if x.tag == "p" else 0 for x in nodes]
    before, seen = [], 0
    for c in chars:
        before.append(seen)
        seen += c
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        chars[up] += chars[i]
        links[up] += links[i]
        tags[up] += tags[i]
        stops[up] += stops[i]
        paragraphs[up] += paragraphs[i]
    own = [_GROUP_BITS.get(x.tag, 0) | (_token_bits(x.attributes) if x.attributes else 0) for x in nodes]
    above, place, same = [0] * n, [0] * n, [1] * n
    for i, x in enumerate(nodes):
        mask, kin = above[i] | own[i], {}
        for k, c in enumerate(x.children):
            above[c], place[c] = mask, k
            kin[nodes[c].tag] = kin.get(nodes[c].tag, 0) + 1
        for c in x.children:
            same[c] = kin[nodes[c].tag]
    rows = []
    for i, x in enumerate(nodes):
        up = max(x.parent, 0)
        family = len(nodes[up].children) if i else 1
        rows.append((chars[i], links[i], tags[i], stops[i], paragraphs[i], x.depth, len(x.children), place[i], family, same[i], chars[up], links[up], tags[up], chars[0], before[i], own[i], above[i]))
    return rows


def describe(rows: list[tuple]) -> np.ndarray:
    """One feature row per node of ``counts``."""
    chars, links, tags, stops, paragraphs, depth, children, place, family, same, up_chars, up_links, up_tags, whole, before, own, above = np.array(rows, np.float64).reshape(-1, 17).T
    one = np.float64(1)
    # What part of a page a node is says something of containers only: the paragraphs of a long text are all small.
    part = lambda of: np.where(children > 0, chars / np.maximum(one, of), -1.0)
    bits = lambda mask: (mask.astype(np.int64)[:, None] >> np.arange(_FLAGS)) & 1
    plain = np.stack([
        np.log1p(chars), np.log1p(links), links / np.maximum(one, chars), np.log1p(tags), chars / (1 + tags), stops / np.maximum(one, chars) * 100, np.log1p(np.minimum(paragraphs, MANY)), depth,
        np.minimum(children, MANY), np.minimum(place, MANY), np.minimum(family - 1 - place, MANY), np.minimum(family, MANY), np.log1p(np.maximum(0, up_chars - chars) / np.maximum(one, family - 1)),
        part(whole), part(up_chars), before / np.maximum(one, whole), np.minimum(same, MANY) / np.minimum(family, MANY), up_chars / (1 + up_tags), up_links / np.maximum(one, up_chars)], 1)
    return np.concatenate([plain, bits(own), bits(above)], 1).astype(np.float32)


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            score += value[at - len(feature)]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss with second-order leaf values; cuts at quantiles of each feature."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.int64)
    share = float(np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99))
    base = math.log(share / (1 - share))
    score, inner = np.full(n, base), (1 << DEPTH) - 1
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, size = (1 << level) - 1, 1 << level
            best, choice = np.full(size, 1e-3), [None] * size
            for j in range(width):
                if not len(cuts[j]):
                    continue
                key = (node - first) * BINS + binned[j]
                left_g = np.cumsum(np.bincount(key, g, size * BINS).reshape(size, BINS), 1)
                left_h = np.cumsum(np.bincount(key, h, size * BINS).reshape(size, BINS), 1)
                all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                gain = left_g ** 2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g ** 2 / (all_h + 1)
                gain[(left_h < 1e-3) | (all_h - left_h < 1e-3)] = 0
                at = gain[:, :len(cuts[j])].argmax(1)
                for k in np.flatnonzero(gain[np.arange(size), at] > best):
                    best[k], choice[k] = gain[k, at[k]], (j, at[k])
            right = np.zeros(n, bool)
            for k, c in enumerate(choice):
                if c is not None:
                    feature[first + k], threshold[first + k] = c[0], cuts[c[0]][c[1]]
                    mine = node == first + k
                    right[mine] = binned[c[0]][mine] > c[1]
            node = 2 * node + 1 + right
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, 1 << DEPTH) / (np.bincount(leaf, h, 1 << DEPTH) + 1)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def decode(page: Page, p: np.ndarray) -> list[bool]:
    """Which nodes are main text, in the most likely labelling that keeps whatever lies below boilerplate boilerplate.

    A node is a frame (its own text is not taken, anything may lie below), main text (boilerplate may lie below) or boilerplate.
    """
    nodes = page.nodes
    n = len(nodes)
    yes, no = np.log(np.clip(p, 1e-6, 1 - 1e-6)), np.log(np.clip(1 - p, 1e-6, 1 - 1e-6))
    frame, main, other = [math.log(0.25)] * n, yes.tolist(), no.tolist()
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        frame[up] += max(frame[i], main[i], other[i])
        main[up] += max(main[i], other[i])
        other[up] += other[i]
    state = [""] * n
    for i in range(n):
        allowed = {"frame": (main, frame, other), "main": (main, other), "other": (other,)}[state[nodes[i].parent] if i else "frame"]
        best = max(allowed, key=lambda s: s[i])
        state[i] = "main" if best is main else "frame" if best is frame else "other"
    return [s == "main" for s in state]


def blocks_of(page: Page, chosen: list[bool]) -> str:
    return "\n\n".join(text for node, text in page.blocks if chosen[node])


_FILLER = ["Home", "About us", "Contact", "Sign in", "Read more", "All rights reserved.", "We use cookies to improve this site.", "Subscribe to our newsletter", "Posted by a reader", "I do not agree with this at all.", "Nice piece, thank you!", "Advertisement"]
_EXTRAS = [
    ("header", 'class="site-header"', "text"), ("div", 'id="header"', "links"), ("aside", 'class="sidebar"', "links"), ("aside", "", "text"), ("div", 'class="sidebar widget"', "text"), ("div", 'class="cookie-notice"', "text"),
    ("div", 'class="notice alert"', "text"), ("div", 'class="newsletter popup"', "form"), ("form", 'class="search"', "form"), ("form", "", "form"), ("section", 'class="comments"', "talk"), ("div", 'id="comments"', "talk"),
    ("div", 'class="comment-list"', "talk"), ("div", 'class="ad"', "text"), ("div", 'class="advert sponsored"', "text"), ("div", 'class="related"', "links"), ("ul", 'class="breadcrumbs"', "links"), ("nav", "", "links"), ("div", 'class="share social"', "links"), ("div", 'class="menu"', "links"), ("footer", 'class="site-footer"', "text"),
]
_FRAMES = [("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'class="post entry-content"'), ("div", 'id="main"'), ("section", 'class="article-body"'), ("div", 'class="story text"'), ("div", "")]
_UNREAD = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_LANDMARK = re.compile(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)


def rewritten(source: str, phrases: list[str], draw: random.Random, plain: bool = False) -> str | None:
    """A labelled copy of a page with a landmark: ``data-y`` tells main text (1) from the rest (0); None without a landmark."""
    source = _UNREAD.sub("", source)
    found = _LANDMARK.search(source)
    if not found:
        return None

    def extra() -> str:
        tag, attributes, kind = draw.choice(_EXTRAS)
        say = lambda: draw.choice(phrases if draw.random() < 0.8 else _FILLER)
        if kind == "links":
            inner = "<ul>" + "".join(f'<li><a href="#">{say()[:40]}</a></li>' for _ in range(draw.randint(3, 9))) + "</ul>"
        elif kind == "form":
            inner = f"<label>{say()[:60]}</label><input><button>{say()[:20]}</button>"
        elif kind == "talk":
            inner = "".join(f'<div class="{draw.choice(["comment", "reply", "entry"])}"><p>{say()}</p></div>' for _ in range(draw.randint(1, 5)))
        else:
            inner = "".join(f"<p>{say()}</p>" for _ in range(draw.randint(1, 3))) if draw.random() < 0.5 else say()
        return f"<{tag} {attributes} data-y=0>{inner}</{tag}>"

    before, inner, after = source[:found.start()], found[2], source[found.end():]
    frame, attributes = (found[1], "") if plain else draw.choice(_FRAMES)
    if not plain:
        if draw.random() < 0.3:
            # One paragraph for each sentence, or for each word.
            inner = re.sub(r"(?<=\.) " if draw.random() < 0.7 else r"(?<=[a-z,.]) ", "</p><p>", inner[:8000] + "</p>" if len(inner) > 8000 else inner)
        if draw.random() < 0.2:
            # A long text.
            inner = inner * min(draw.choice([3, 10, 40]), 1 + 20_000 // max(1, len(inner)))
        parts = re.split(r"(?=<p\b)", inner)
        for _ in range(draw.choice([0, 0, 1, 2])):
            parts.insert(draw.randint(1, len(parts)), extra())
        inner = "".join(parts)
        before += "".join(extra() for _ in range(draw.randint(0, 3)))
        after = "".join(extra() for _ in range(draw.randint(0, 3))) + after
    return f"{before}<{frame} {attributes} data-y=1>{inner}</{frame}>{after}"


def truth(page: Page) -> list[float]:
    """Share of main text below each node, by the nearest ``data-y`` around each block."""
    mark = []
    for x in page.nodes:
        own = 1.0 if "data-y=1" in x.attributes else 0.0 if "data-y=0" in x.attributes else None
        mark.append(own if own is not None else mark[x.parent] if x.parent >= 0 else 0.0)
    good = [x.chars * m for x, m in zip(page.nodes, mark)]
    every = [x.chars for x in page.nodes]
    for i in range(len(page.nodes) - 1, 0, -1):
        good[page.nodes[i].parent] += good[i]
        every[page.nodes[i].parent] += every[i]
    return [g / e if e else m for g, e, m in zip(good, every, mark)]


def fit(pages: list[str], seed: int = 11) -> Trees:
    """Trees for the pages of a sample and built-in pages, so that a sample without landmarks still gives a model."""
    draw = random.Random(seed)
    own = ["<html><head><title>x</title></head><body><nav><ul>" + "".join(f'<li><a href="#">{w}</a></li>' for w in _FILLER[:5]) + "</ul></nav><article><h1>On things</h1>" + "".join(f"<p>{' '.join(draw.choices('this is what we know of it and that some more words follow, one by one. So'.split(), k=draw.randint(5, 80)))}</p>" for _ in range(6)) + "</article><footer>&copy; us</footer></body></html>" for _ in range(6)]
    phrases = [t for p in pages[:60] for _, t in parse(p).blocks if len(t) < 400][:2000] or _FILLER
    xs, ys = [], []
    for source in [*own, *pages]:
        for copy in range(COPIES + 1):
            again = rewritten(source, phrases, draw, plain=copy == 0)
            if again is None:
                break
            page = parse(again)
            labels = truth(page)
            for x in page.nodes:
                # Some nodes lose their attributes, so that structure has to tell.
                x.attributes = "" if draw.random() < 0.2 else x.attributes.replace("data-y=1", "").replace("data-y=0", "")
            xs.append(describe(counts(page)))
            ys.append(np.array(labels))
    x, share = np.concatenate(xs), np.concatenate(ys)
    return boost(x, (share >= 0.5).astype(float), np.maximum(0.05, np.abs(2 * share - 1)))


def learn(pages: DataFrame) -> Trees:
    """Fit on at most SAMPLE different pages of at most SAMPLE_CHARS, first in the order of a hash of the page.

    Hashes alone are sorted; the pages themselves travel for the sample only.
    """
    short = pages.select(F.xxhash64("html").alias("h"), "html").where(F.length("html") <= SAMPLE_CHARS)
    chosen = short.select("h").distinct().orderBy("h").limit(SAMPLE)
    drawn = short.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("html").alias("html"))
    return fit([r.html for r in sorted(drawn.collect(), key=lambda r: r.h)])


def extract(pages: DataFrame, trees: Trees) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``.

    A null or empty page, and a page without main text, gives an empty text. Repeated rows give equal results; a null url stays
    null. Whole pages are read, of any length and depth; unclosed elements end with the page. Other columns are ignored.
    """
    frame = pages.select("page_id", "url", "html")
    held = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, waiting, rows, count = [], [], [], 0

            def flush() -> None:
                if waiting:
                    p = np.split(held.value.probability(describe([x for r in rows for x in r])), np.cumsum([len(r) for r in rows])[:-1])
                    texts.extend(blocks_of(page, decode(page, q)) for page, q in zip(waiting, p))
                    waiting.clear()
                    rows.clear()

            for value in batch.column(2):
                page = parse(value.as_py())
                waiting.append(page)
                rows.append(counts(page))
                count += len(page.nodes)
                if count > BATCH_NODES:
                    flush()
                    count = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [frame.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return frame.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def main_text(pages: DataFrame) -> DataFrame:
    return extract(pages, learn(pages))
