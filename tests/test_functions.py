"""Text, geometry and chat functions against plain Python."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.functions import chat, geometry, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "response, answer",
    [
        ("<answer>a</answer> then <answer> b\n</answer>", "b"),
        ("<answer>line\nbreak</answer>", "line\nbreak"),
        ("<answer>so \\boxed{7} it \\boxed{ 8 }</answer>", "8"),
        ("\\boxed{x}", "x"),
        ("neither ", "neither "),
        ("", ""),
        ("<answer></answer>", ""),
        ("<answer>20</answer>", "20"),
    ],
)
def test_rule_answer(spark, response, answer):
    assert one(spark, text.rule_answer(F.col("c")), c=response) == answer


def test_left_crop_at_its_bound(spark):
    assert one(spark, text.left_crop(F.col("c")), c="x" * 1000) == "x" * 1000
    assert one(spark, text.left_crop(F.col("c")), c="a" + "x" * 1000) == "[cropped] ... " + "x" * 1000


@pytest.mark.parametrize("reply, loose, strict", [("<correct>", True, True), ("<wrong>", False, False), ("Incorrect", True, False), ("<Correct>", True, True)])
def test_verdict(spark, reply, loose, strict):
    assert one(spark, text.verdict(F.col("c")), c=reply) is loose
    assert one(spark, text.verdict(F.col("c"), True), c=reply) is strict


def test_filled_leaves_braces_of_fields(spark):
    assert one(spark, text.filled("{a} and {b} {other}", a=F.col("c"), b=F.lit("{a}")), c="{b}") == "{b} and {a} {other}"


def test_paths(spark):
    assert one(spark, text.integer_stem(F.col("c")), c="a/b/0012.jpg") == 12
    assert one(spark, text.integer_stem(F.col("c")), c="a/b/x12.jpg") is None
    assert one(spark, text.extension(F.col("c")), c="a/b/7.JPG") == ".jpg"
    assert one(spark, text.joined_path(F.lit("/r/"), F.col("c")), c="/abs/x") == "/abs/x"
    assert one(spark, text.joined_path(F.lit("/r/"), F.col("c")), c="x") == "/r/x"
    assert one(spark, text.image_candidates(F.col("c")), c="d.1/a.gif")[:2] == ["d.1/a.gif", "d.1/a.jpg"]
    assert one(spark, text.capitalised(F.col("c")), c="hELLO you") == "Hello you"


def test_wrapped(spark):
    assert one(spark, text.wrapped(F.col("c"), 10), c="one two three four") == "one two\nthree four"
    assert one(spark, text.wrapped(F.col("c"), 10), c="  ") == "N/A"


def test_data_url(spark):
    url = text.data_url(F.encode(F.col("c"), "utf-8"))
    assert one(spark, F.decode(text.data_url_bytes(url), "utf-8"), c="é" * 100) == "é" * 100
    assert one(spark, text.data_url_bytes(F.col("c")), c="https://x/y.jpg") is None


def boxes(value):
    """What a box's text means, in plain Python."""
    s = value.strip()
    s = s[1:-1] if s.startswith("[") and s.endswith("]") else s
    parts = [p for p in s.replace(" ", "").split(",") if p]
    try:
        return [float(p) for p in parts] if len(parts) == 4 else None
    except ValueError:
        return None


@pytest.mark.parametrize("value", ["[1,2,3,4]", "1, 2.5,3,4", " [1 , 2, 3, 4] ", "1,2,3", "a,b,c,d", "", "[1,2,3,4", "1,,2,3,4", "[-1,2e2,3,4]", "[]"])
def test_parse_bbox(spark, value):
    got = one(spark, geometry.parse_bbox(F.col("c")), c=value)
    assert (list(got) if got else None) == boxes(value)


def test_bbox_ratio_of_nothing(spark):
    assert one(spark, geometry.bbox_ratio(geometry.parse_bbox(F.col("c")), F.lit(10.0)), c="x") == 0.0
    assert one(spark, geometry.bbox_ratio(geometry.parse_bbox(F.col("c")), F.lit(10.0)), c="5,5,1,9") == 0.0


RECTS = st.tuples(*[st.integers(-5, 30)] * 4)


def table_of(spark, rects):
    names = [f"{r}{k}" for r in "ab" for k in ("x0", "y0", "x1", "y1")]
    df = spark.createDataFrame([(*a, *b) for a, b in rects], ", ".join(f"{n} long" for n in names))
    both = [geometry.rect(*[F.col(f"{r}{k}") for k in ("x0", "y0", "x1", "y1")]) for r in "ab"]
    return df, *both


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(RECTS, RECTS), min_size=1, max_size=60))
def test_rectangles(spark, rects):
    df, a, b = table_of(spark, rects)
    got = df.select(geometry.rect_area(a).alias("area"), geometry.rect_intersect(a, b).alias("hit"), geometry.clip_rect(a, F.lit(20), F.lit(10)).alias("cut"), geometry.align_down(F.col("ax0"), 7).alias("down")).collect()
    for r, (p, q) in zip(got, rects, strict=True):
        assert r["area"] == max(0, p[2] - p[0]) * max(0, p[3] - p[1])
        assert r["hit"] == (p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3])
        x0, y0, x1, y1 = r["cut"]
        assert 0 <= x0 <= x1 <= 20 and 0 <= y0 <= y1 <= 10
        assert r["down"] == math.floor(p[0] / 7) * 7


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.tuples(*[st.integers(0, 30)] * 4), st.tuples(*[st.integers(0, 30)] * 4)), min_size=1, max_size=40))
def test_free_space_is_what_is_not_used(spark, rects):
    """A free rectangle and the pieces left of it cover the same cells but for the used ones."""
    whole = [((min(a[0], a[2]), min(a[1], a[3]), max(a[0], a[2]) + 1, max(a[1], a[3]) + 1), (min(b[0], b[2]), min(b[1], b[3]), max(b[0], b[2]) + 1, max(b[1], b[3]) + 1)) for a, b in rects]
    df, a, b = table_of(spark, whole)
    cells = lambda r: {(x, y) for x in range(r[0], r[2]) for y in range(r[1], r[3])}
    for r, (f, u) in zip(df.select(geometry.split_free(F.array(a), b).alias("left")).collect(), whole, strict=True):
        left = set().union(*[cells(tuple(x)) for x in r["left"]])
        assert left == cells(f) - cells(u)


def test_equal_rectangles_contain_each_other(spark):
    r = geometry.rect(*[F.lit(v) for v in (0, 0, 4, 4)])
    assert one(spark, F.size(geometry.none_contained(F.array(r, r))), c=1) == 0


@pytest.mark.parametrize("w, h, ratio", [(100, 50, 1.0), (50, 100, 1.0), (100, 100, 1.0), (5, 1000, 2.0), (0, 10, 1.0), (101, 50, 0.5)])
def test_center_crop(spark, w, h, ratio):
    x0, y0, x1, y1 = one(spark, geometry.center_crop(F.col("w"), F.col("h"), F.lit(ratio)), w=w, h=h)
    assert 0 <= x0 <= x1 <= w and 0 <= y0 <= y1 <= h
    if w and abs(w / h - ratio) < 1e-9:
        assert (x0, y0, x1, y1) == (0, 0, w, h)
    elif w and w / h > ratio:
        assert (y0, y1) == (0, h) and x1 - x0 == max(1, min(w, round(h * ratio)))


@pytest.mark.parametrize("w, h, low, high", [(10, 10, 400, None), (100, 100, None, 400), (10, 10, 1000, 500), (3, 7, None, None)])
def test_resize_dims(spark, w, h, low, high):
    got = one(spark, geometry.resize_dims(F.col("w"), F.col("h"), low, high), w=w, h=h)
    if low and w * h < low:
        s = (low / (w * h)) ** 0.5
        w, h = math.ceil(w * s), math.ceil(h * s)
    if high and w * h > high:
        s = (high / (w * h)) ** 0.5
        w, h = math.floor(w * s), math.floor(h * s)
    assert tuple(got) == (w, h)


def test_transcript_and_pruning(spark):
    system = chat.message(F.lit("system"), text=F.lit("s"))
    asked = chat.query_message(F.lit("what?"), F.lit("http://x/a.jpg"))
    empty = chat.message(F.lit("assistant"))
    said = F.array(system, asked, empty)
    assert one(spark, chat.formatted(said), c=1) == "[USER]\n<image>what?\n[ASSISTANT]\n<content missing>\n"
    assert one(spark, chat.formatted(said, omit_image_data=False, omit_system_prompt=False), c=1).startswith("[SYSTEM]\ns\n[USER]\n[image_url](http://x/a.jpg)what?")
    kept = one(spark, chat.pruned(asked)["content_parts"], c=1)
    assert [(p["text"], p["image_url"] and p["image_url"]["url"]) for p in kept] == [(None, "[pruned]"), ("what?", None)]
    assert one(spark, chat.formatted(F.array(chat.pruned(asked)), omit_image_data=False), c=1) == "[USER]\n[image_url]([pruned])what?\n"


def test_messages_of_any_form(spark):
    raw = ['{"role":"user","content":"hi"}', '{"role":"user","content":[{"type":"text","text":"a"},{"type":"image_url","image_url":{"url":"u"}}]}', '{"role":"assistant","content":null}']
    rows = spark.createDataFrame([(r,) for r in raw], "j string").select(chat.normalised(F.parse_json("j")).alias("m")).select("m.*").collect()
    assert rows[0]["content_text"] == "hi" and rows[0]["content_parts"] is None
    assert [p["type"] for p in rows[1]["content_parts"]] == ["text", "image_url"]
    assert rows[2]["content_text"] is None and rows[2]["content_parts"] is None


def test_framing(spark):
    assert re.match(r">+ m messages start >+\nx<+ m messages stop <+\n$", one(spark, chat.framed(F.lit("m"), F.lit("x")), c=1))


def test_white_space_of_a_megabyte_is_stripped_in_linear_time(spark):
    """A run of white space inside a text once took time that grew with its square."""
    import time

    gap = " \t" * 500_000
    df = spark.createDataFrame([(f"{gap}a{gap}b{gap}",), (f"[1,{gap}2, 3, 4]{gap}x",)], "t string").cache()
    df.count()
    spark.range(1).select(text.strip(F.lit(" x ")), geometry.parse_bbox(F.lit("1,2,3,4"))).collect()
    begun = time.monotonic()
    got = df.select(F.char_length(text.strip(F.col("t"))).alias("n"), geometry.parse_bbox(F.col("t")).isNull().alias("bad")).collect()
    assert time.monotonic() - begun < 3
    assert got[0]["n"] == 1_000_002 and all(r["bad"] for r in got)


def test_pieces_equal_the_split_of_an_array(spark):
    rows = [(x, y, x + w, y + h) for x in (-5, 0, 3, 9) for y in (-5, 0, 4, 9) for w in (1, 5, 30) for h in (2, 30)]
    df = spark.createDataFrame(rows, "x0 long, y0 long, x1 long, y1 long").select(F.struct("*").alias("u"))
    whole = geometry.rect(*[F.lit(v).cast("long") for v in (0, 0, 10, 10)])
    got = df.select(F.array_compact(F.array(*[F.when(there, r) for there, r in geometry.pieces(whole, F.col("u"))])).alias("a"), geometry.split_free(F.array(whole), F.col("u")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and any(len(r["a"]) > 2 for r in got)


def test_unclosed_tags_take_linear_time(spark):
    import time

    many = "<answer>" * 100_000
    df = spark.createDataFrame([(f"<answer>a</answer>{many}",), (many,), ("\\boxed{" * 100_000,), ("x</answer> <answer> b </answer> }",)], "t string").cache()
    df.count()
    begun = time.monotonic()
    got = [r[0] for r in df.select(text.rule_answer(F.col("t"))).collect()]
    assert time.monotonic() - begun < 5
    assert got == ["a", many, "\\boxed{" * 100_000, "b"]
