"""Main text of web pages by minimum-cut labelling.

A page becomes text blocks; consecutive blocks of one kind under one parent form a node. A logistic
classifier, trained here on generated pages, turns each node's cost of being content or boilerplate
into terminal capacities. Neighbours in page order and siblings in the tree are tied by smoothness
edges that weaken with their distance in the tree. The maximum flow's cut separates content from
boilerplate, and the content's blocks are joined in page order.

Nodes are linear in the page and every page is one row, so nothing is shuffled.

Defined cases: a null or empty page, or one without content, gives an empty text; broken markup is
read as far as it goes (unclosed elements end with their parent, an unclosed tag at the next "<" and
an unclosed comment or script with the page), and none of it reaches the text; a very long page takes
time in proportion; equal costs leave a node with the boilerplate; repeated rows each get a row; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quote opens a value only after "="; a value ends at its quote however far that is. A quote whose partner
#: isn't in the rest of the page is one by itself: no other like it follows, so the rest is looked through once.
#: A tag that isn't closed ends at the next "<" or the page's end.
_ATTRIBUTES = r"""(?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+"""
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript|template|title|svg|iframe|object|canvas|textarea|select)\b{_ATTRIBUTES}>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^<>]*+>?"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)({_ATTRIBUTES})>?",
    re.S | re.I,
)
_CUES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes, up to the nearest of the containers.
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ())}
BOILERPLATE_TAGS = frozenset("nav footer aside form header menu dialog button fieldset option head".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_WORDS = frozenset("ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar side nav navigation navbar menu footer foot header masthead topbar breadcrumb breadcrumbs comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice alert warning newsletter subscribe subscription signup register login social share sharing related recommended recommendations popular trending widget popup modal overlay search copyright legal disclaimer pagination pager toolbar complementary contentinfo form outbrain taboola paywall".split())
CONTENT_WORDS = frozenset("article content post entry main story body text maintext articlebody".split())


@dataclass
class Element:
    tag: str
    cue: int  # -1 boilerplate, 1 content, 0 neither
    signature: str
    parent: int
    depth: int
    nearest: int = 0  # the cue of the nearest element with one, this included
    bad: int = 0  # boilerplate cues from here up
    good: int = 0


@dataclass
class Node:
    """Consecutive blocks of one kind under one parent."""

    element: int
    parent: int
    signature: str
    blocks: list[str] = field(default_factory=list)
    linked: int = 0


def _cue(tag: str, attributes: str) -> tuple[int, str]:
    """What a tag and its class, id and role say, and their text."""
    names = " ".join(a or b or c for a, b, c in _CUES.findall(attributes)) if attributes else ""
    if tag in BOILERPLATE_TAGS or attributes and _HIDDEN.search(attributes):
        return -1, names
    words = {w.lower() for w in _PART.findall(names)}
    if words & BOILERPLATE_WORDS and tag not in ("body", "html"):
        return -1, names
    return (1 if tag in CONTENT_TAGS or words & CONTENT_WORDS else 0), names


def parse(page: str) -> tuple[list[Element], list[Node]]:
    elements, nodes = [Element("", 0, "", -1, 0)], []
    stack, pieces, links, linked = [0], [], 0, 0
    opened: Counter[str] = Counter()

    def enter(tag: str, cue: int, signature: str) -> None:
        up = elements[stack[-1]]
        elements.append(Element(tag, cue, signature, stack[-1], up.depth + 1, cue or up.nearest, up.bad + (cue < 0), up.good + (cue > 0)))
        stack.append(len(elements) - 1)
        opened[tag] += 1

    def leave(k: int) -> None:
        for at in stack[k:]:
            opened[elements[at].tag] -= 1
        del stack[k:]

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                at = stack[-1]
                e = elements[at]
                # A container's own text is a kind beside its children.
                own = (at, e.parent, e.signature)
                last = nodes[-1] if nodes else None
                if last is None or (last.parent, last.signature) != own[1:]:
                    nodes.append(last := Node(*own))
                last.blocks.append(text)
                last.linked += min(linked, len(text))
        pieces, linked = [], 0

    def close(names: tuple[str, ...], stop: tuple[str, ...]) -> None:
        if not any(opened[x] for x in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = elements[stack[k]].tag
            if tag in names:
                leave(k)
                return
            if tag in stop:
                return

    end = 0
    for m in _TAG.finditer(page):
        if m.start() > end:
            pieces.append(page[end : m.start()])
            if links:
                linked += m.start() - end
        end = m.end()
        if not m[3]:
            if m[1] and m[1].lower() in ("textarea", "select"):
                flush()
            continue
        tag = m[3].lower()
        if tag not in BLOCK_TAGS:
            if tag == "a":
                links = 0 if m[2] else 1
            elif tag == "br":
                pieces.append(" ")
            elif tag == "button":
                flush()
                if m[2]:
                    close(("button",), ())
                else:
                    enter(tag, -1, tag)
            continue
        flush()
        if m[2]:
            close((tag,), ("article", "main", "body") if tag == "p" else ())
            continue
        if tag in VOID_TAGS:
            continue
        links = 0
        if elements[stack[-1]].tag == "p":
            leave(len(stack) - 1)
        if tag in CLOSED_BY:
            names, stop = CLOSED_BY[tag]
            for _ in names.split():
                close(tuple(names.split()), stop)
        cue, names = _cue(tag, m[4])
        enter(tag, cue, f"{tag} {names}")
    pieces.append(page[end:])
    flush()
    return elements, nodes


FEATURES = 12


def features(elements: list[Element], nodes: list[Node]) -> np.ndarray:
    out = np.zeros((len(nodes), FEATURES))
    for i, n in enumerate(nodes):
        own = elements[n.element]
        nearest, bad, good = own.nearest, own.bad, own.good
        chars = sum(map(len, n.blocks))
        tag = own.tag
        marks = sum(b.count(".") + b.count(",") for b in n.blocks)
        out[i] = (1.0, nearest < 0, nearest > 0, min(bad, 3), min(good, 3), bad > 0 and good == 0, math.log1p(chars / len(n.blocks)), math.log1p(chars), n.linked / max(chars, 1), min(1.0, 20 * marks / max(chars, 1)), tag in ("h1", "h2", "h3", "h4", "h5", "h6"), tag in ("p", "blockquote", "pre"))
    return out


class FlowNetwork:
    """Maximum flow by shortest augmenting levels (Dinic) on a small graph."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[float] = []

    def add(self, a: int, b: int, forward: float, backward: float = 0.0) -> None:
        for x, y, c in ((a, b, forward), (b, a, backward)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(c)

    def source_side(self, s: int, t: int) -> list[bool]:
        """Which vertices are on the source's side of a minimum cut."""
        tiny = 1e-9
        while True:
            level = [-1] * len(self.out)
            level[s], queue = 0, [s]
            for x in queue:
                for e in self.out[x]:
                    if self.room[e] > tiny and level[self.to[e]] < 0:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if level[t] < 0:
                return [k >= 0 for k in level]
            turn, path, x = [0] * len(self.out), [], s
            while True:
                if x == t:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    k = next(i for i, e in enumerate(path) if self.room[e] <= tiny)
                    x = self.to[path[k] ^ 1]
                    del path[k:]
                    continue
                while turn[x] < len(self.out[x]):
                    e = self.out[x][turn[x]]
                    if self.room[e] > tiny and level[self.to[e]] == level[x] + 1:
                        break
                    turn[x] += 1
                else:
                    if x == s:
                        break
                    e = path.pop()
                    x = self.to[e ^ 1]
                    turn[x] += 1
                    continue
                path.append(e)
                x = self.to[e]


def _tree_distance(elements: list[Element], a: int, b: int) -> int:
    steps = 0
    while a != b:
        if elements[a].depth < elements[b].depth:
            a, b = b, a
        a = elements[a].parent
        steps += 1
    return steps


def label(elements: list[Element], nodes: list[Node], weights: np.ndarray, adjacent: float = 1.5, sibling: float = 1.0) -> list[bool]:
    """Which nodes are content."""
    if not nodes:
        return []
    score = features(elements, nodes) @ weights
    n = len(nodes)
    net = FlowNetwork(n + 2)
    last: dict[int, int] = {}
    for i, (node, z) in enumerate(zip(nodes, score.tolist(), strict=True)):
        z = min(max(z, -8.0), 8.0)
        net.add(n, i, max(z, 0.0))
        net.add(i, n + 1, max(-z, 0.0))
        if i:
            w = adjacent / (1 + _tree_distance(elements, nodes[i - 1].element, node.element))
            net.add(i - 1, i, w, w)
        if node.parent in last and last[node.parent] != i - 1:
            net.add(last[node.parent], i, sibling / 2, sibling / 2)
        last[node.parent] = i
    return net.source_side(n, n + 1)[:n]


def extract(page: str | None, weights: np.ndarray) -> str:
    elements, nodes = parse(page or "")
    return "\n".join(b for n, keep in zip(nodes, label(elements, nodes, weights), strict=True) if keep for b in n.blocks)


def training_pages(n: int = 300, seed: int = 11) -> Iterator[tuple[str, set[str]]]:
    """Generated pages with the texts of their content blocks."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9)))
    says = lambda a, b: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
    sentence = lambda: says(4, 14) + r.choice(". . , ? !".split())
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{word()}'>{says(1, 3)}</a></li>" for _ in range(r.randint(2, 8))) + "</ul>"

    def wrapped(tags: str, names: str, inner: str) -> str:
        if r.random() < 0.5:
            return f"<{(t := r.choice(tags.split()))}>{inner}</{t}>"
        return f"<div {r.choice(['class', 'id'])}='{r.choice(names.split())}'>{inner}</div>"

    for _ in range(n):
        content: set[str] = set()

        def own(text: str) -> str:
            content.add(text)  # noqa: B023
            return text

        body = [f"<h1>{own(says(2, 8))}</h1>"]
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.75:
                body.append(f"<p>{own(' '.join(sentence() for _ in range(r.randint(1, 6))))}</p>")
            elif kind < 0.85:
                body.append(f"<h2>{own(says(2, 6))}</h2>")
            elif kind < 0.93:
                body.append("<ul>" + "".join(f"<li>{own(says(2, 9))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            else:
                body.append(f"<blockquote>{own(sentence())}</blockquote>")
            if r.random() < 0.08:
                body.append(f"<div class='{r.choice(['ad', 'share', 'related', 'newsletter'])}'><p>{sentence()}</p></div>")
        if r.random() < 0.2:
            body.append(f"<section class='comments'><p>{sentence()}</p><p>{sentence()} {sentence()}</p></section>")
        main = "".join(body)
        main = f"<{(t := r.choice(['article', 'main']))}>{main}</{t}>" if r.random() < 0.6 else f"<div class='{r.choice(['content', 'post', 'entry-content', 'story-body', 'wrap', 'col'])}'>{main}</div>"
        before = [wrapped("nav header menu", "menu navbar nav topbar", menu()), wrapped("header", "header masthead banner", f"<p>{says(1, 5)}</p>"), wrapped("aside", "ad advert cookie-notice notice", f"<p>{sentence()}</p>"), wrapped("form", "search login newsletter", f"<label>{says(1, 3)}</label><button>{says(1, 1)}</button>")]
        after = [wrapped("aside", "sidebar related widget", menu() if r.random() < 0.5 else f"<p>{sentence()}</p>"), wrapped("section", "comments comment-list", "".join(f"<p>{sentence()} {sentence()}</p>" for _ in range(r.randint(1, 4)))) if r.random() < 0.4 else "<div id='comments'><p>" + sentence() + "</p></div>", wrapped("footer", "footer copyright legal", f"<p>{says(2, 9)}</p>"), f"<p>{says(1, 3)}</p>"]
        yield "<html><body>" + "".join(x for x in before if r.random() < 0.6) + main + "".join(x for x in after if r.random() < 0.6) + "</body></html>", content


@functools.lru_cache(1)
def _trained() -> tuple[float, ...]:
    x, y = [], []
    for page, content in training_pages():
        elements, nodes = parse(page)
        x.append(features(elements, nodes))
        y += [2 * sum(b in content for b in n.blocks) > len(n.blocks) for n in nodes]
    a, t = np.concatenate(x), np.array(y, float)
    w = np.zeros(FEATURES)
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-a @ w))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.5 * np.eye(FEATURES)
        w -= np.linalg.solve(h, a.T @ (p - t) + 0.5 * w)
    return tuple(w)


def train() -> np.ndarray:
    """Weights of the block classifier (fixed data, so the same everywhere)."""
    return np.array(_trained())


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    weights = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
