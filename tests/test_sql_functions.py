"""Functions in SQL against those on columns."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tessella.functions import chat, geometry, sql
from tessella.operators import evaluation


def test_outcomes(spark):
    sql.register(spark)
    rows = [(*flags, reason) for flags in product([True, False, None], repeat=3) for reason in ("stop", "length", None)]
    df = spark.createDataFrame(rows, "s boolean, c boolean, i boolean, f string")
    both = df.select(F.expr("outcome(s, c, i, f)").alias("a"), evaluation.status(F.col("s"), F.col("c"), F.col("i"), F.col("f")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and len({r["a"] for r in both}) == 4


def test_boxes(spark):
    sql.register(spark)
    texts = ["[1, 2, 3, 4]", "1,2,3,4", " [1.5,2,,3,4]\t", "[1,2,3]", "a,2,3,4", "", None, "[]", "[1,2,3,4", "1,2,3,4,5", "(1,2,3,4)", "[ -1 , 2e1,3, 4 ]"]
    both = spark.createDataFrame([(t,) for t in texts], "c string").select("c", F.expr("parse_box(c)").alias("a"), geometry.parse_bbox(F.col("c")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and sum(r["a"] is not None for r in both) == 4


def test_crops(spark):
    sql.register(spark)
    rows = [(w, h, r) for w in (-1, 0, 1, 7, 100, 333) for h in (0, 1, 9, 100, 512) for r in (0.0, 0.3, 1.0, 1.7, 3.33)]
    both = spark.createDataFrame(rows, "w long, h long, r double").select(F.expr("center_crop(w, h, r)").alias("a"), geometry.center_crop(F.col("w"), F.col("h"), F.col("r")).alias("b")).collect()
    assert all(tuple(r["a"]) == tuple(r["b"]) for r in both)


def test_transcripts(spark):
    sql.register(spark)
    part = lambda kind, text=None, url=None: (kind, text, (url, None) if url else None)
    messages = [("user", "hi", None), ("System", "x", None), (None, None, None), ("assistant", None, [part("text", "t"), part("image_url", None, "u"), part(None), part("audio"), part("text")])]
    kind = "messages array<struct<role:string,content_text:string,content_parts:array<struct<type:string,text:string,image_url:struct<url:string,detail:string>>>>>"
    (row,) = spark.createDataFrame([(messages,)], kind).select(F.expr("transcript(messages)").alias("a"), chat.formatted(F.col("messages")).alias("b")).collect()
    assert row["a"] == row["b"] and "<unexpected content part type: audio>" in row["a"]


def test_free_parts(spark):
    sql.register(spark)
    rows = [(i, 0, 0, 10, 10, x, y, x + w, y + h) for i, (x, y, w, h) in enumerate(product((-2, 3, 10), (0, 8), (4, 30), (1, 12)))]
    df = spark.createDataFrame(rows, "id long, a long, b long, c long, d long, x0 long, y0 long, x1 long, y1 long")
    free, used = geometry.rect(*[F.col(k) for k in "abcd"]), geometry.rect(*[F.col(k) for k in ("x0", "y0", "x1", "y1")])
    wanted = df.select("id", F.explode(geometry.split_free(F.array(free), used)).alias("p")).select("id", "p.*").collect()
    got = spark.sql("SELECT id, p.* FROM (SELECT id, named_struct('x0', a, 'y0', b, 'x1', c, 'y1', d) AS f, named_struct('x0', x0, 'y0', y0, 'x1', x1, 'y1', y1) AS u FROM {df}), LATERAL free_parts(f, u) AS p", df=df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and len(got) > 20
