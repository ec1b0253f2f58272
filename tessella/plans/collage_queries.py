"""Queries that make collages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import collage, sampling
from ..sources.checkpoints import staged
from ..sources.readers import table
from .registry import query


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 36 + 240, F.col("p_partkey") * 37 % 1400 + 260
    box = F.concat(F.lit("["), F.concat_ws(", ", F.lit("4"), F.lit("4"), F.lit("10"), F.lit("10")), F.lit("]"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("uid"), F.concat(F.lit("img/"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image"), w.alias("img_width"), h.alias("img_height"),
        F.when(F.col("p_partkey") % 3 == 0, box).alias("bbox"), F.col("p_name").alias("question"), F.col("p_brand").alias("answer"),
    )


def _round(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = _images(spark, sf_dir)
    return staged(collage.make_round(images, max(16, images.count() // 100), 8, seed=42), "round")


@query(
    "collage_rules",
    "SELECT CAST(0 AS BIGINT) AS overlapping, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS narrow, CAST(0 AS BIGINT) AS over_share, CAST(0 AS BIGINT) AS under_scale, CAST(0 AS BIGINT) AS repeated_fills, CAST(0 AS BIGINT) AS wrong_counts, true AS some",
)
def collage_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of all collages that break a rule, of which there are none.

    Disjoint and on the canvas, as wide as the least short edge, objects within
    their share, others not below the least scale, no image twice as a fill, and
    the counts of the canvas.
    """
    s, made = collage.Settings(), _round(spark, sf_dir)
    rows = made.select("collage_index", "canvas", F.explode("layouts").alias("x")).select(
        "collage_index", F.col("canvas.width").alias("w"), F.col("canvas.height").alias("h"), F.col("x.layout_id").alias("n"), F.col("x.layout_area").alias("area"), F.col("x.image_type").alias("kind"),
        F.col("x.object_bbox_ratio").alias("rho"), F.col("x.scale_ratio").alias("scale"), F.col("x.src_img").alias("image"), geometry.rect(*[F.get("x.layout_bbox", F.lit(i)) for i in range(4)]).alias("r"),
    )
    pairs = rows.alias("a").join(rows.alias("b"), "collage_index").where(F.col("a.n") < F.col("b.n"))  # the layouts of one canvas, some tens at most
    met = pairs.agg(F.count_if(geometry.rect_intersect(F.col("a.r"), F.col("b.r"))).alias("overlapping"))
    fill, boxed = F.col("kind") == "fill", F.col("rho") > 0
    short = F.least(F.col("r")["x1"] - F.col("r")["x0"], F.col("r")["y1"] - F.col("r")["y0"])
    inside = geometry.rect_contains(geometry.rect(F.lit(0), F.lit(0), F.col("w"), F.col("h")), F.col("r"))
    each = rows.agg(
        F.count_if(~inside).alias("outside"), F.count_if(short < s.min_short_edge).alias("narrow"), F.count_if(~fill & boxed & (F.col("rho") * F.col("area") / (F.col("w") * F.col("h")) > s.rho_max + 1e-12)).alias("over_share"),
        F.count_if(~fill & ~boxed & (F.col("scale") < s.lambda_down - 1e-9)).alias("under_scale"),
    )
    fills = rows.where(fill).groupBy("collage_index", "image").count().agg(F.count_if(F.col("count") > 1).alias("repeated_fills"))
    counted = made.agg(F.count_if(F.col("canvas.layout_count") != F.size("layouts")).alias("wrong_counts"), (F.count(F.lit(1)) > 0).alias("some"))
    return met.crossJoin(each).crossJoin(fills).crossJoin(counted)  # four tables of one row


@query("collage_pack")
def collage_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collages from all parts as images, with their layouts; one for each hundred images."""
    made = _round(spark, sf_dir)
    return made.select("collage_index", F.col("canvas.width").alias("width"), F.col("canvas.height").alias("height"), F.col("canvas.layout_count").alias("layout_count"), F.explode("layouts").alias("x")).select(
        "collage_index", "width", "height", "layout_count", "x.layout_id", "x.src_idx", "x.image_type", "x.layout_area"
    )


@query("collage_rounds")
def collage_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds until there is one collage for each hundred images, half of them a round, with the uses of earlier rounds counted in later ones."""
    images = _images(spark, sf_dir)
    total = max(16, images.count() // 100)
    for _, _, images in collage.make_all(images, total, -(-total // 2), 8, seed=7):
        pass
    return images.select("uid", "core_count", "alt_count", "fill_count")


@query(
    "balance_lexi",
    """
    WITH RECURSIVE u AS (SELECT l_partkey AS uid, CAST(bool_or(l_returnflag = 'A') AS INTEGER) AS c, CAST(bool_or(l_returnflag = 'N') AS INTEGER) AS a, CAST(bool_or(l_returnflag = 'R') AS INTEGER) AS f FROM lineitem GROUP BY l_partkey),
    o AS (SELECT *, row_number() OVER (ORDER BY c + a + f DESC, c DESC, a DESC, f DESC, uid) AS i FROM u),
    m AS (SELECT sum(c) / 8.0::DOUBLE AS mc, sum(a) / 8.0::DOUBLE AS ma, sum(f) / 8.0::DOUBLE AS mf, count(*) / 8.0::DOUBLE AS mn FROM u),
    w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS uid, CAST(0 AS BIGINT) AS k, [0, 0, 0, 0, 0, 0, 0, 0] AS sc, [0, 0, 0, 0, 0, 0, 0, 0] AS sa, [0, 0, 0, 0, 0, 0, 0, 0] AS sf, [0, 0, 0, 0, 0, 0, 0, 0] AS sn
          UNION ALL
          SELECT p.i, p.uid, p.k, [CASE WHEN j = p.k THEN p.sc[j] + p.c ELSE p.sc[j] END FOR j IN [1, 2, 3, 4, 5, 6, 7, 8]], [CASE WHEN j = p.k THEN p.sa[j] + p.a ELSE p.sa[j] END FOR j IN [1, 2, 3, 4, 5, 6, 7, 8]],
                 [CASE WHEN j = p.k THEN p.sf[j] + p.f ELSE p.sf[j] END FOR j IN [1, 2, 3, 4, 5, 6, 7, 8]], [CASE WHEN j = p.k THEN p.sn[j] + 1 ELSE p.sn[j] END FOR j IN [1, 2, 3, 4, 5, 6, 7, 8]]
          FROM (SELECT o.i, o.uid, o.c, o.a, o.f, w.sc, w.sa, w.sf, w.sn,
                       list_sort([{'x': abs(w.sc[j] + o.c - m.mc), 'y': abs(w.sa[j] + o.a - m.ma), 'z': abs(w.sf[j] + o.f - m.mf), 'n': abs(w.sn[j] + 1 - m.mn) * 0.05::DOUBLE, 'k': j} FOR j IN [1, 2, 3, 4, 5, 6, 7, 8]])[1].k AS k
                FROM w JOIN o ON o.i = w.i + 1, m) p)
    SELECT uid, CAST(k - 1 AS INTEGER) AS chunk FROM w WHERE i > 0
    """,
)
def balance_lexi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images dealt to the chunk whose used roles come nearest to the average."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("uid")).agg(*[F.count_if(F.col("l_returnflag") == f).alias(c) for f, c in zip("ANR", sampling.ROLE_COUNTS, strict=True)])
    return sampling.balanced_lexi(rows, 8, "uid").select("uid", "chunk")
