"""The functions that queries in SQL text may want, defined in SQL and registered in a session.

Each says what its DataFrame counterpart says; tests hold both together.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_BOX = "STRUCT<x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
_RECT = "STRUCT<x0: BIGINT, y0: BIGINT, x1: BIGINT, y1: BIGINT>"
_PART = "STRUCT<type: STRING, text: STRING, image_url: STRUCT<url: STRING, detail: STRING>>"
_WHITE = "concat(' ', char(9), char(10), char(11), char(12), char(13))"

#: By name: parameters, what is returned, and the body.
FUNCTIONS = {
    # P16
    "outcome": (
        "success BOOLEAN, is_correct BOOLEAN, inferred BOOLEAN, finish_reason STRING",
        "STRING",
        "CASE WHEN coalesce(success, false) THEN CASE WHEN coalesce(is_correct, false) THEN 'correct' ELSE 'wrong' END WHEN coalesce(inferred, false) AND NOT coalesce(finish_reason = 'stop', false) THEN 'incomplete' ELSE 'invalid' END",
    ),
    # F8: a box from four numbers in an array, and from text
    "box_of": (
        "v ARRAY<DOUBLE>",
        _BOX,
        "CASE WHEN size(v) = 4 AND NOT exists(v, x -> x IS NULL) THEN named_struct('x0', v[0], 'y0', v[1], 'x1', v[2], 'y1', v[3]) END",
    ),
    "bare_text": ("c STRING", "STRING", f"CASE WHEN btrim(c, {_WHITE}) LIKE '[%' AND btrim(c, {_WHITE}) LIKE '%]' THEN substr(btrim(c, {_WHITE}), 2, char_length(btrim(c, {_WHITE})) - 2) ELSE btrim(c, {_WHITE}) END"),
    "parse_box": ("c STRING", _BOX, "box_of(transform(filter(split(replace(bare_text(c), ' ', ''), ','), p -> p <> ''), p -> try_cast(p AS DOUBLE)))"),
    # G8
    "center_crop": (
        "width BIGINT, height BIGINT, ratio DOUBLE",
        _RECT,
        """CASE WHEN width <= 0 OR height <= 0 OR ratio <= 0 OR abs(ln(width / greatest(1.0D, height) / ratio)) < 1e-6 THEN named_struct('x0', 0L, 'y0', 0L, 'x1', width, 'y1', height)
        WHEN width / greatest(1.0D, height) > ratio THEN named_struct('x0', (width - greatest(1L, least(width, CAST(bround(height * ratio, 0) AS BIGINT)))) div 2, 'y0', 0L,
             'x1', (width - greatest(1L, least(width, CAST(bround(height * ratio, 0) AS BIGINT)))) div 2 + greatest(1L, least(width, CAST(bround(height * ratio, 0) AS BIGINT))), 'y1', height)
        ELSE named_struct('x0', 0L, 'y0', (height - greatest(1L, least(height, CAST(bround(width / ratio, 0) AS BIGINT)))) div 2,
             'x1', width, 'y1', (height - greatest(1L, least(height, CAST(bround(width / ratio, 0) AS BIGINT)))) div 2 + greatest(1L, least(height, CAST(bround(width / ratio, 0) AS BIGINT)))) END""",
    ),
    # D14 for one free rectangle and a used one, as a table
    "free_parts": (
        f"f {_RECT}, u {_RECT}",
        "TABLE (x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)",
        """SELECT p.x0, p.y0, p.x1, p.y1 FROM (SELECT explode(CASE WHEN f.x0 < u.x1 AND u.x0 < f.x1 AND f.y0 < u.y1 AND u.y0 < f.y1 THEN array(
             named_struct('x0', f.x0, 'y0', f.y0, 'x1', f.x1, 'y1', u.y0), named_struct('x0', f.x0, 'y0', u.y1, 'x1', f.x1, 'y1', f.y1),
             named_struct('x0', f.x0, 'y0', greatest(f.y0, u.y0), 'x1', u.x0, 'y1', least(f.y1, u.y1)), named_struct('x0', u.x1, 'y0', greatest(f.y0, u.y0), 'x1', f.x1, 'y1', least(f.y1, u.y1))) ELSE array(f) END) AS p)
           WHERE p.x1 > p.x0 AND p.y1 > p.y0""",
    ),
    # messages without their images and system prompts
    "transcript": (
        f"messages ARRAY<STRUCT<role: STRING, content_text: STRING, content_parts: ARRAY<{_PART}>>>",
        "STRING",
        """array_join(transform(filter(messages, m -> upper(coalesce(m.role, '')) <> 'SYSTEM'), m -> concat('[', upper(coalesce(m.role, 'unknown')), ']', char(10), coalesce(m.content_text,
           array_join(transform(m.content_parts, p -> CASE WHEN p.type IS NULL THEN '<content part missing \\'type\\'>' WHEN p.type = 'text' THEN coalesce(p.text, '<content part text missing>')
             WHEN p.image_url IS NOT NULL THEN '<image>' ELSE concat('<unexpected content part type: ', p.type, '>') END), ''), '<content missing>'), char(10))), '')""",
    ),
}

def register(spark: SparkSession) -> list[str]:
    """Define the functions in a session, as temporary ones; their names."""
    for name, (parameters, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return list(FUNCTIONS)
