"""Labelled pages to learn from: invented prose in layouts of many kinds, with the label of each node.

Layouts are drawn with a fixed seed.  A node is content if it belongs to the
article; what an article carries besides (sharing bars, adverts, related links,
reader comments, forms, embedded elements) is not.
"""

from __future__ import annotations

import random

from .dom import EMBEDDED, VOID

Node = tuple[str, str, int, list]  # tag, attributes, label, children (nodes or strings)

SYLLABLES = "ba de ki lo mu na pe ri so tu va we xi yo za ther ing ation ol ent".split()


class _Layout:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join((w := self.words(4, 18))[0].upper() + w[1:] + self.rng.choice(["", ", " + self.words(2, 6)]) + "." for _ in range(self.rng.randint(low, high)))

    def attributes(self, *names: str) -> str:
        name = self.rng.choice(names)
        return f' {self.rng.choice(["class", "id"])}="{name}{self.rng.choice(["", "", " box", "-wrap", " x1"])}"'

    def paragraph(self, label: int = 1) -> Node:
        r = self.rng
        parts: list = [self.sentences(1, 5)]
        if r.random() < 0.2:
            parts += [(r.choice(["b", "em", "a", "span", "strong"]), "", label, [self.words(1, 4)]), " " + self.sentences(1, 2)]
        if r.random() < 0.1:
            parts += [("br", "", label, []), self.sentences(1, 1)]
        return ("p", "", label, parts)

    def links(self, n: int, tag: str = "ul") -> Node:
        return (tag, "", 0, [("li", "", 0, [("a", ' href="/x"', 0, [self.words(1, 4)])]) for _ in range(n)])

    def chrome(self, kind: str) -> Node:
        r = self.rng
        if kind == "nav":
            return r.choice([("nav", "", 0, [self.links(r.randint(3, 8))]), ("div", self.attributes("nav", "menu", "navbar", "breadcrumb"), 0, [self.links(r.randint(3, 8))])])
        if kind == "header":
            return r.choice([("header", "", 0, [("a", "", 0, [self.words(1, 3)]), ("p", "", 0, [self.words(2, 6)])]), ("div", self.attributes("header", "masthead", "logo"), 0, [("span", "", 0, [self.words(1, 4)])])])
        if kind == "footer":
            inner = ["© " + self.sentences(1, 2)] if r.random() < 0.5 else [("p", "", 0, ["© " + self.sentences(1, 2)]), self.links(2)]
            return ("footer", "", 0, inner) if r.random() < 0.6 else ("div", self.attributes("footer", "copyright", "bottom"), 0, inner)
        if kind == "aside":
            inner = [("h3", "", 0, [self.words(1, 3)]), self.links(r.randint(2, 6))] if r.random() < 0.6 else [("p", "", 0, [self.sentences(1, 2)])]
            return ("aside", "", 0, inner) if r.random() < 0.5 else ("div", self.attributes("sidebar", "widget", "related", "popular"), 0, inner)
        if kind == "ad":
            return (r.choice(["div", "div", "section", "aside"]), self.attributes("ad", "ads", "advert", "sponsored", "promo", "banner"), 0, [self.sentences(1, 2)] if r.random() < 0.6 else [("p", "", 0, [self.sentences(1, 2)]), ("a", "", 0, [self.words(1, 3)])])
        if kind == "notice":
            return ("div", self.attributes("cookie", "consent", "notice", "newsletter", "popup", "alert"), 0, [("p", "", 0, [self.sentences(1, 3)]), ("button", "", 0, [self.words(1, 2)])])
        if kind == "form":
            return ("form", "", 0, [("label", "", 0, [self.words(1, 3)]), ("input", ' type="text"', 0, []), ("button", "", 0, [self.words(1, 2)])] + ([("p", "", 0, [self.sentences(1, 1)])] if r.random() < 0.4 else []))
        if kind == "embedded":
            tag = r.choice(sorted(EMBEDDED))
            return (tag, "", 0, [r.choice([("b", "", 0, [self.words(1, 4)]), ("p", "", 0, [self.sentences(1, 2)]), ("option" if tag == "select" else "text", "", 0, [self.words(1, 3)]), self.words(1, 6)]) for _ in range(r.randint(1, 3))])
        if kind == "share":
            return ("div", self.attributes("share", "social", "tags", "toolbar"), 0, [("a", "", 0, [self.words(1, 1)]) for _ in range(r.randint(2, 5))])
        one = lambda: (r.choice(["div", "li", "article"]) if r.random() < 0.8 else "p", self.attributes("comment", "reply"), 0, [("b", "", 0, [self.words(1, 2)]), ("p", "", 0, [self.sentences(1, 4)])])
        return (r.choice(["section", "div", "ol"]), self.attributes("comments", "discussion", "disqus", "respond"), 0, [("h3", "", 0, [self.words(1, 2)])] + [one() for _ in range(r.randint(1, 5))])

    def article(self) -> list[Node]:
        r = self.rng
        body: list[Node] = [("h1", "", 1, [self.words(3, 10)])] if r.random() < 0.85 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            kind = r.random()
            if kind < 0.72:
                body.append(self.paragraph())
            elif kind < 0.8:
                body.append((r.choice(["ul", "ol"]), "", 1, [("li", "", 1, [self.sentences(1, 2)]) for _ in range(r.randint(2, 5))]))
            elif kind < 0.86:
                body.append((r.choice(["h2", "h3"]), "", 1, [self.words(2, 7)]))
            elif kind < 0.9:
                body.append(("blockquote", "", 1, [self.paragraph()]))
            elif kind < 0.94:
                body.append(("table", "", 1, [("tr", "", 1, [("td", "", 1, [self.words(1, 6)]) for _ in range(3)]) for _ in range(r.randint(2, 4))]))
            else:
                body.append(("div", "", 1, [self.sentences(1, 3)]))
            if r.random() < 0.15:
                body.append(self.chrome(r.choice(["ad", "share", "aside", "form", "notice", "embedded"])))
        if r.random() < 0.25:
            body.append(self.chrome(r.choice(["comments", "share", "aside", "nav"])))
        return body

    def page(self) -> Node:
        r = self.rng
        head = ("head", "", 0, [("meta", ' charset="utf-8"', 0, []), ("title", "", 0, [self.words(3, 9)]), ("style", "", 0, ["p{margin:0}"]), ("script", "", 0, ['var t="' + self.words(1, 3) + '";'])])
        inner = self.article()
        shape = r.random()
        if shape < 0.4:
            core: list[Node] = [("article", "", 1, inner)]
        elif shape < 0.5:
            core = [("main", "", 1, [("article", "", 1, inner)] if r.random() < 0.5 else inner)]
        elif shape < 0.75:
            core = [("div", self.attributes("content", "post", "entry", "article", "story", "main"), 1, inner)]
        elif shape < 0.85:
            core = [("section", "", 1, inner)]
        elif shape < 0.93:
            core = [("div", "", 1, inner)]
        else:
            core = inner
        before = [self.chrome(k) for k in ("nav", "header", "ad", "notice", "form") if r.random() < 0.45]
        after = [self.chrome(k) for k in ("comments", "aside", "ad", "form", "nav", "footer") if r.random() < 0.4]
        r.shuffle(before)
        parts = before + core + after
        if r.random() < 0.25:
            parts = [("div", self.attributes("wrapper", "page", "container"), 0, parts)]
        if r.random() < 0.3:
            parts.append(("script", "", 0, ["track(" + self.words(1, 2) + ");"]))
        return ("html", ' lang="en"', 0, [head, ("body", "", 0, parts)])


def written(node: Node | str, labels: list[int]) -> str:
    """The node as html; adds the labels of it and of what it holds, in order."""
    if isinstance(node, str):
        return node.replace("&", "&amp;").replace("<", "&lt;")
    tag, attributes, label, children = node
    labels.append(label)
    inner = "".join(written(c, labels) for c in children)
    return f"<{tag}{attributes}>" if tag in VOID else f"<{tag}{attributes}>{inner}</{tag}>"


def content_text(node: Node | str, label: int = 0, blocks: list[list[str]] | None = None) -> list[list[str]]:
    """The labelled text of a page as blocks of strings, to measure extraction against."""
    from .dom import BLOCK

    blocks = [[]] if blocks is None else blocks
    if isinstance(node, str):
        if label:
            blocks[-1].append(node)
        return blocks
    tag, _, own, children = node
    if tag in BLOCK:
        blocks.append([])
    if tag == "br" and label:
        blocks[-1].append(" ")
    for c in children:
        content_text(c, own, blocks)
    if tag in BLOCK:
        blocks.append([])
    return blocks


def layouts(n: int = 300, seed: int = 11) -> list[Node]:
    rng = random.Random(seed)
    return [_Layout(rng).page() for _ in range(n)]


def labelled_pages(n: int = 300, seed: int = 11) -> list[tuple[str, list[int]]]:
    """``n`` pages as (html, labels of the nodes in order, the root's first)."""
    out = []
    for page in layouts(n, seed):
        labels = [0]
        source = "<!DOCTYPE html>" + written(page, labels)
        out.append((source, labels))
    return out
