"""Web pages as trees: a tolerant parser, and features of the nodes."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

#: Elements without content, elements whose content isn't markup, elements that hold what isn't text of the page, and elements that start a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
EMBEDDED = frozenset("noscript template svg math object canvas audio video select".split())
BLOCK = frozenset(
    "html body head title article aside address blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
#: What an opening tag closes, if it is open within the bounds named.
CLOSES = {
    **{t: ({"p"}, frozenset("button table td th caption body".split())) for t in BLOCK - {"html", "body", "head", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption"}},
    "li": ({"li"}, frozenset("ul ol menu dir".split())),
    "dd": ({"dd", "dt"}, frozenset({"dl"})),
    "dt": ({"dd", "dt"}, frozenset({"dl"})),
    "td": ({"td", "th"}, frozenset({"tr", "table"})),
    "th": ({"td", "th"}, frozenset({"tr", "table"})),
    "tr": ({"tr"}, frozenset({"table"})),
    "option": ({"option"}, frozenset({"select"})),
    "body": ({"head"}, frozenset()),
}

#: Comments, declarations and tags.  Quoted values may hold anything; where quotes don't match, a tag ends at the next ">".  No part can be matched in two ways, so time stays linear.
TAG = re.compile(
    r"""<(?:!--(?:.*?--!?>|.*\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/><]*+)((?:(?:[^<>"']++|"[^"]*"|'[^']*')*+(?=>))|[^<>]*+)>)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden|itemprop)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""", re.I)
TOKEN = re.compile(r"[a-z]+|\d+")

#: Groups of elements, and of words in an element's class, id or role.
GROUPS = (
    "article main", "section", "div center", "p", "h1 h2 h3 h4 h5 h6 hgroup", "li dd dt", "ul ol dl menu", "a", "span b i em strong u small font mark code sub sup q cite abbr time br wbr",
    "nav", "header", "footer", "aside", "form input button label textarea fieldset legend option optgroup datalist", "script style noscript iframe template svg math object canvas audio video select xmp noembed noframes",
    "table tbody thead tfoot tr td th caption", "blockquote pre", "figure figcaption img", "head title meta link base", "html body",
)
WORDS = (
    "content article post entry story main text articlebody prose",
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager topbar tabs toc",
    "ad ads advert advertisement advertising adsbygoogle sponsor sponsored promo promotion banner teaser outbrain taboola",
    "comment comments reply replies disqus respond discussion commentlist",
    "footer copyright colophon legal bottom",
    "header masthead logo branding top",
    "sidebar aside widget related recommended recommendations more popular trending rail",
    "cookie cookies consent notice alert popup modal overlay newsletter subscribe gdpr warning message toast",
    "share sharing social tags meta byline author tools toolbar",
    "search login signup register form contact poll survey",
)
_GROUP_OF = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
_WORD_OF = {w: i for i, g in enumerate(WORDS) for w in g.split()}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Page:
    """The nodes of a page in order (a parent comes before its children), and its runs of text."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    attributes: list[str] = field(default_factory=lambda: [""])
    runs: list[tuple[int, int, str]] = field(default_factory=list)  # node, block, text


class _Open:
    """The open elements, and where each name stands among them; every step costs what it closes."""

    def __init__(self) -> None:
        self.nodes, self.names = [0], [""]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: int, name: str) -> None:
        self.places.setdefault(name, []).append(len(self.nodes))
        if name in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.names.append(name)

    def last(self, names) -> int:
        """The innermost place of any of the names; 0 if none is open."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def close(self, place: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.nodes) > place:
            self.nodes.pop()
            name = self.names.pop()
            self.places[name].pop()
            if name in BLOCK:
                self.blocks.pop()


class _Tags:
    """Whether an element that may hold anything is closed: the next tag of its name is an end tag.  Each part of a page is searched once for each name."""

    def __init__(self, source: str) -> None:
        self.source, self.next, self.search = source, {}, {}

    def closed(self, name: str, at: int) -> bool:
        place, ends = self.next.get(name, (-1, False))
        if place < at:
            find = self.search.setdefault(name, re.compile(rf"<(/?){name}(?=[\s/>])", re.I))
            m = find.search(self.source, at)
            place, ends = (m.start(), bool(m[1])) if m else (len(self.source), False)
            self.next[name] = place, ends
        return ends


def parse(source: str) -> Page:
    """Read a page as it comes: tags may be unclosed, crossed or cut off, and nested as deep as they like.  Text in the root (node 0) has no element around it.

    An embedded element that nothing closes is taken to be empty, so that it
    doesn't swallow what follows.
    """
    page, still, tags = Page(), _Open(), _Tags(source)
    block, at = 0, 0
    end, find = len(source), TAG.search
    nodes = still.nodes
    tag, parent, depth, attributes, runs = page.tag, page.parent, page.depth, page.attributes, page.runs
    while at < end:
        m = find(source, at)
        stop = m.start() if m else end
        if stop > at:
            runs.append((nodes[-1], block, html.unescape(source[at:stop])))
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                runs.append((nodes[-1], block, m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                block += 1
            place = still.last((name,))
            if place and (name in BLOCK or not still.blocks or place > still.blocks[-1]):  # a stray inline end tag closes no block
                still.close(place)
            continue
        if name in CLOSES:
            closed, bounds = CLOSES[name]
            place = still.last(closed)
            if place and place > still.last(bounds):
                still.close(place)
        if name in BLOCK:
            block += 1
        tag.append(name)
        parent.append(nodes[-1])
        depth.append(len(nodes))
        attributes.append(m[3] or "")
        ended = (m[3] or "").endswith("/")
        if name in VOID:
            if name == "br":
                runs.append((nodes[-1], block, " "))
        elif name in RAW and not ended:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>]|$)[^>]*>?", re.I).search(source, at)
            stop = close.start() if close else end
            if stop > at:
                runs.append((len(tag) - 1, block, html.unescape(source[at:stop]) if name in ("title", "textarea") else source[at:stop]))
            at = close.end() if close else end
        elif (not ended or name in BLOCK) and (name not in EMBEDDED or tags.closed(name, at)):
            still.push(len(tag) - 1, name)
    return page


_described: dict[str, tuple[float, ...]] = {}


def _description(attributes: str) -> tuple[float, ...]:
    """Which groups of words an element's class, id and role have, and whether it is hidden."""
    if not attributes:
        return (0.0,) * (len(WORDS) + 1)
    found = _described.get(attributes)
    if found is None:
        flags, hidden = [0.0] * len(WORDS), 0.0
        for m in ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or "").strip("\"'")
            if kind == "style":
                hidden = max(hidden, float(bool(_HIDDEN.search(value))))
            elif kind == "hidden" or (kind == "aria-hidden" and value == "true"):
                hidden = 1.0
            else:
                for w in TOKEN.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
                    if w in _WORD_OF:
                        flags[_WORD_OF[w]] = 1.0
        found = (*flags, hidden)
        if len(_described) < 10_000:
            _described[attributes] = found
    return found


#: A feature for each group of elements and words; being hidden; the same of the nearest enclosing element that says anything; then sizes.
WIDTH = len(GROUPS) + 2 * (len(WORDS) + 1) + 8 + 8
_OUTER = [_GROUP_OF[t] for t in ("article", "nav", "header", "footer", "aside", "form", "script", "head")]


@dataclass
class Trees:
    """The nodes of several pages one after another; each page's root is its own parent's -1."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray  # the group of each node
    features: np.ndarray
    first: list[int]  # of each page

    @cached_property
    def levels(self) -> list[np.ndarray]:
        """The nodes of each depth from 1 on, in order."""
        return by_depth(self.depth)


def by_depth(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))[1:]


def trees(pages: list[Page]) -> Trees:
    """The nodes' features, for all pages at once."""
    sizes = [len(p.tag) for p in pages]
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    n = int(sum(sizes))
    parent = np.concatenate([np.array(p.parent) + (f if len(p.parent) else 0) for p, f in zip(pages, first, strict=True)]) if pages else np.zeros(0, np.int64)
    parent[first] = -1
    depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.zeros(0, np.int64)
    kind = np.array([_GROUP_OF.get(t, len(GROUPS)) for p in pages for t in p.tag], np.int64)
    own = np.array([_description(a) for p in pages for a in p.attributes], float).reshape(n, len(WORDS) + 1)
    size, linked, stops, words, early = (np.zeros(n) for _ in range(5))
    for p, f in zip(pages, first, strict=True):
        total, so_far = sum(len(t) for _, _, t in p.runs) or 1, 0
        seen = set()
        for node, _, t in p.runs:
            k = f + node
            if k not in seen:
                seen.add(k)
                early[k] = so_far / total
            so_far += len(t)
            size[k] += len(t.strip())
            stops[k] += t.count(".") + t.count(",")
            words[k] += t.count(" ") + 1
    a = _GROUP_OF["a"]
    linked[kind == a] = size[kind == a]
    own_size = size.copy()
    levels = by_depth(depth)
    for nodes in levels[::-1]:
        for x in (size, linked, stops, words):
            np.add.at(x, parent[nodes], x[nodes])
    outer = np.zeros((n, len(WORDS) + 1 + len(_OUTER)))
    mine = np.concatenate([own, np.stack([kind == g for g in _OUTER], axis=1)], axis=1).astype(float)
    for nodes in levels:
        up = parent[nodes]
        outer[nodes] = np.maximum(outer[up], mine[up])
    groups = np.zeros((n, len(GROUPS) + 1))
    groups[np.arange(n), kind] = 1
    sizes_ = np.stack(
        [
            np.log1p(size) / 5,
            np.log1p(own_size) / 5,
            linked / np.maximum(size, 1),
            np.minimum(10 * stops / np.maximum(words, 1), 3),
            (words > 8).astype(float),
            np.minimum(depth, 12) / 6,
            early,
            np.ones(n),
        ],
        axis=1,
    )
    return Trees(parent, depth, kind, np.concatenate([groups[:, :-1], own, outer, sizes_], axis=1), first.tolist())
