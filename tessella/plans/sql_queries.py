"""Queries in SQL text, with the functions that the library registers in a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import sql
from ..sources.readers import table
from .evaluation_queries import _messages
from .geometry_queries import _RECTS, _rects
from .registry import query


def _run(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    """A statement over named tables, which it sees as arguments, not as views of the session."""
    sql.register(spark)
    return spark.sql(text, **views)


@query(
    "sql_outcomes",
    """
    WITH s AS (SELECT event_type, CASE WHEN value > 40 THEN CASE WHEN user_id % 2 = 0 THEN 'correct' ELSE 'wrong' END WHEN user_id % 3 = 0 AND user_id % 5 <> 0 THEN 'incomplete' ELSE 'invalid' END AS outcome FROM events)
    SELECT event_type, outcome, count(*) AS n FROM s GROUP BY ALL
    """,
)
def sql_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16 in SQL: outcomes of events that stand for results."""
    statement = "SELECT event_type, outcome(value > 40, user_id % 2 = 0, user_id % 3 = 0, CASE WHEN user_id % 5 = 0 THEN 'stop' ELSE 'length' END) AS outcome, count(*) AS n FROM {events} GROUP BY ALL"
    return _run(spark, statement, events=table(spark, sf_dir, "events"))


@query(
    "sql_boxes",
    """
    WITH a AS (SELECT o_orderkey, o_orderkey % 1000 / 8 AS x, o_custkey % 500 / 4 AS y, o_orderkey % 4 AS kind FROM orders)
    SELECT o_orderkey, CASE WHEN kind < 2 THEN x END AS x0, CASE WHEN kind < 2 THEN y END AS y0, CASE WHEN kind < 2 THEN x + 7 END AS x1, CASE WHEN kind < 2 THEN y + 9 END AS y1 FROM a
    """,
)
def sql_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 in SQL: boxes as text in brackets or bare, with three numbers, and with a word."""
    statement = r"""
    WITH a AS (SELECT o_orderkey, o_orderkey % 1000 / 8 AS x, o_custkey % 500 / 4 AS y, o_orderkey % 4 AS kind FROM {orders}),
    b AS (SELECT o_orderkey, parse_box(CASE kind WHEN 0 THEN concat(' [', x, ', ', y, ',', x + 7, ' ,', y + 9, ']\n') WHEN 1 THEN concat_ws(',', x, y, x + 7, y + 9) WHEN 2 THEN concat_ws(',', x, y, x) ELSE concat('[a,', x, ',', y, ',', x, ']') END) AS box FROM a)
    SELECT o_orderkey, box.* FROM b
    """
    return _run(spark, statement, orders=table(spark, sf_dir, "orders"))


@query(
    "sql_transcripts",
    """
    SELECT conv_id, string_agg('[' || CASE WHEN turn % 2 = 0 THEN 'USER' ELSE upper(role) END || ']' || chr(10) || CASE WHEN turn % 2 = 0 THEN '<image>' ELSE '' END || text || chr(10), '' ORDER BY turn) FILTER (WHERE turn % 2 = 0 OR upper(role) <> 'SYSTEM') AS transcript
    FROM conversations GROUP BY conv_id
    """,
)
def sql_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9 in SQL: conversations as text, images left out."""
    return _run(spark, "SELECT conv_id, transcript(messages) AS transcript FROM {rows}", rows=_messages(spark, sf_dir))


@query(
    "sql_crops",
    """
    WITH a AS (SELECT p_partkey, CAST(p_size * 31 AS BIGINT) AS w, CAST(p_partkey % 800 + 1 AS BIGINT) AS h, CAST(0.5 AS DOUBLE) + (p_partkey % 4) * CAST(0.25 AS DOUBLE) AS ratio FROM part),
    b AS (SELECT *, greatest(1, least(w, CAST(round_even(h * ratio, 0) AS BIGINT))) AS nw, greatest(1, least(h, CAST(round_even(w / ratio, 0) AS BIGINT))) AS nh, w / greatest(1.0, h) AS now FROM a),
    c AS (SELECT *, abs(ln(now / ratio)) < 1e-6 AS whole FROM b)
    SELECT p_partkey, CASE WHEN whole OR now <= ratio THEN 0 ELSE (w - nw) // 2 END AS x0, CASE WHEN whole OR now > ratio THEN 0 ELSE (h - nh) // 2 END AS y0,
           CASE WHEN whole OR now <= ratio THEN w ELSE (w - nw) // 2 + nw END AS x1, CASE WHEN whole OR now > ratio THEN h ELSE (h - nh) // 2 + nh END AS y1 FROM c
    """,
)
def sql_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G8 in SQL: centred crops to an aspect ratio."""
    statement = "SELECT p_partkey, c.* FROM (SELECT p_partkey, center_crop(p_size * 31, p_partkey % 800 + 1, 0.5D + (p_partkey % 4) * 0.25D) AS c FROM {part})"
    return _run(spark, statement, part=table(spark, sf_dir, "part"))


@query(
    "sql_free_parts",
    "WITH "
    + _RECTS
    + """
    , u AS (SELECT canvas, k, greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, x1, y1 FROM r WHERE x1 > x0 AND y1 > y0 AND x0 < 400 AND y0 < 250 AND x1 > 0 AND y1 > 0),
    p AS (SELECT canvas, k, 0 AS x0, 0 AS y0, 400 AS x1, y0 AS y1 FROM u UNION ALL SELECT canvas, k, 0, y1, 400, 250 FROM u UNION ALL SELECT canvas, k, 0, y0, x0, least(250, y1) FROM u UNION ALL SELECT canvas, k, x1, y0, 400, least(250, y1) FROM u)
    SELECT canvas, k, x0, y0, x1, y1 FROM p WHERE x1 > x0 AND y1 > y0
    """,
)
def sql_free_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 in SQL: what is left of a canvas beside each rectangle, by a table function."""
    statement = """
    SELECT canvas, k, p.* FROM (SELECT canvas, k, named_struct('x0', greatest(x0, 0L), 'y0', greatest(y0, 0L), 'x1', x1, 'y1', y1) AS u FROM {rects} WHERE x1 > x0 AND y1 > y0 AND x0 < 400 AND y0 < 250 AND x1 > 0 AND y1 > 0),
    LATERAL free_parts(named_struct('x0', 0L, 'y0', 0L, 'x1', 400L, 'y1', 250L), u) AS p
    """
    return _run(spark, statement, rects=_rects(spark, sf_dir))
