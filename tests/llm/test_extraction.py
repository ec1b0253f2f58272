"""Pages with deep, unclosed and embedded markup."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tessella.llm import extraction, labelled_pages
from tessella.llm.dom import by_depth, parse

HEAD, FOOT = "<html><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>", "<footer><p>Copyright 2020 by us.</p></footer></body></html>"
FIRST, SECOND = "The first paragraph tells, with some words, what happened today.", "The second paragraph goes on, and it ends the report of the day."
BODY = f"<h1>A title of some words</h1><p>{FIRST}</p><p>{SECOND}</p>"
WANTED = f"A title of some words\n{FIRST}\n{SECOND}"


@pytest.fixture(scope="module")
def model():
    return extraction.fit(labelled_pages.labelled_pages())


def text_of(model, html):
    return extraction.extract_many([html], model)[0]


@pytest.mark.parametrize("depth", [1, 20, 520, 5_000])
def test_deep_articles_are_kept_and_menus_are_not(model, depth):
    assert text_of(model, HEAD + "<div>" * depth + f"<article>{BODY}</article>" + "</div>" * depth + FOOT) == WANTED
    assert text_of(model, HEAD + "<div>" * depth + f"<article>{BODY}</article>" + FOOT) == WANTED


@pytest.mark.parametrize("tag", ["video", "audio", "select", "svg", "math", "object", "canvas", "noscript", "template"])
def test_embedded_elements_swallow_nothing(model, tag):
    unclosed = f"<article><h1>A title of some words</h1><p>{FIRST}<{tag} width=3></p><p>{SECOND}</p></article>"
    assert text_of(model, HEAD + unclosed + FOOT) == WANTED
    later = unclosed.replace("</article>", f"</article><{tag}>fallback</{tag}>")
    assert text_of(model, HEAD + later + FOOT) == WANTED
    closed = f"<article>{BODY.replace('</h1>', f'</h1><{tag}><b>can not</b> be shown here</{tag}>')}</article>"
    assert text_of(model, HEAD + closed + FOOT) == WANTED


def test_markup_inside_mathml_and_svg_is_read_as_markup():
    page = parse("<p>x<math><mi>a</mi><mo>&lt;</mo><mi>b</mi></math><svg><path d='M0'/><text>t</text></svg>y</p>")
    assert page.tag[1:] == ["p", "math", "mi", "mo", "mi", "svg", "path", "text"]
    assert [page.tag[p] for p in page.parent[2:]] == ["p", "math", "math", "math", "p", "svg", "svg"]
    assert not any("<m" in t or "</" in t for _, _, t in page.runs)


@pytest.mark.parametrize("html", ["<div>" * 60_000, "<b><i>" * 30_000 + "</b></i></p>" * 30_000, "<div><b>" * 20_000 + "</b>" * 20_000 + "</i>" * 20_000, "<li>" * 60_000, "<video>" * 40_000, "<table><tr><td>" * 15_000, "<svg><a>" * 20_000 + "</svg>" * 20_000])
def test_time_does_not_grow_with_depth(html):
    began = time.perf_counter()
    parse(html)
    half = time.perf_counter()
    parse(html[: len(html) // 4])
    assert half - began < 3 and half - began < 12 * (time.perf_counter() - half) + 0.3


def test_nodes_by_depth():
    depth = np.array([0, 1, 2, 1, 0, 1, 2, 3])
    assert [x.tolist() for x in by_depth(depth)] == [[1, 3, 5], [2, 6], [7]]
    assert by_depth(np.zeros(3, np.int64)) == [] and by_depth(np.zeros(0, np.int64)) == []
