"""Greedy matching of panels with images over a whole table, in rounds of proposals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import staged
from .bandjoin import TAU, fitting
from .sampling import band_weight


def ranked_candidates(panels: DataFrame, images: DataFrame, weight: Column, k: int, tau: float = TAU) -> DataFrame:
    """The k images that suit each panel best, of those in its band: all columns of both, ``score`` and ``place`` from 1.

    ``weight`` is made of the images' columns.  Images of one size and weight
    differ in their uid only, so the k smallest stand for all, and k such kinds
    are enough for a panel.  A narrow band of aspect ratios is looked through
    first: a panel whose k-th best there beats whatever lies outside is settled,
    the others go on to a band four times as wide, and at last to the whole one.
    """
    kind = ["area", "ratio", "_weight"]
    pool = images.withColumn("_weight", weight).withColumn("_nth", F.row_number().over(Window.partitionBy(*kind).orderBy("uid"))).where(F.col("_nth") <= k)
    pool = pool.groupBy(*kind).agg(F.min("uid").alias("_first"), F.collect_list(F.struct(*images.columns)).alias("_rows"))
    kinds = staged(pool.withColumn("_kind", F.monotonically_increasing_id()), "kinds")
    n, most = kinds.agg(F.count(F.lit(1)), F.max("_weight")).first()
    near, left, found = tau * min(1.0, 64 * k / max(1, n)), staged(panels, "panels"), []
    while True:
        met = fitting(left, kinds.drop("_rows"), near).withColumn("score", band_weight(F.col("ratio"), F.col("panel_ratio"), F.col("_weight")))
        place = F.row_number().over(Window.partitionBy("panel_id").orderBy(F.desc("score"), "_first"))
        best = staged(met.withColumn("_place", place).where(F.col("_place") <= k).select(*panels.columns, "_kind", "score", "_place"), "best")
        if near >= tau:
            found.append(best)
            break
        outside = max((most or 0.0) / (1 + 0.8 * x) for x in (near, tau))
        settled = staged(best.where((F.col("_place") == k) & (F.col("score") > outside + 1e-9 * abs(outside))).select("panel_id"), "settled")
        found.append(best.join(settled, "panel_id", "left_semi"))
        left, near = staged(left.join(settled, "panel_id", "left_anti"), "left"), min(tau, 4 * near)
    every = reduce(DataFrame.unionByName, found).join(kinds.select("_kind", "_rows"), "_kind").select(*panels.columns, "score", F.inline("_rows"))
    order = Window.partitionBy("panel_id").orderBy(F.desc("score"), "uid")
    return every.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def matched(candidates: DataFrame, scope: tuple[str, ...] = ()) -> DataFrame:
    """At most one image for each panel, and each image once in ``scope`` (columns such as the canvas; the whole table if there are none).

    ``candidates`` has panel_id, panel_area, uid and place (1 for the best).
    Every panel proposes to its best image; an image keeps the largest panel that
    proposed so far (ties: the smallest id), and the others go on to their next.
    This ends where panels that choose one after another, the largest first, would
    end.  A round moves only the panels that were turned down; what images hold is
    one row a panel, pre-aggregated before it is shuffled, however many panels
    propose to one image.

    A panel that all its candidates turn down isn't in the result; an empty table
    gives an empty one.
    """
    key = [*scope, "uid"]
    better = lambda p="": F.struct((-F.col(f"{p}panel_area")).alias("area"), F.col(f"{p}panel_id").alias("panel_id"))
    ranked = staged(candidates.select("panel_id", "panel_area", "place", *key), "candidates")
    held, asking = None, ranked.where(F.col("place") == 1)
    while True:
        now = asking if held is None else held.unionByName(asking)
        best = now.groupBy(*key).agg(F.min(F.struct(better().alias("by"), "place")).alias("b"))
        held, before = staged(best.select(F.col("b.by.panel_id").alias("panel_id"), (-F.col("b.by.area")).alias("panel_area"), F.col("b.place").alias("place"), *key), "held"), now
        turned = before.join(held.select("panel_id"), "panel_id", "left_anti").select("panel_id", F.col("place").alias("_last"))
        # on to the next that isn't held by a better one: what is held only gets better
        rest = ranked.join(turned, "panel_id").where(F.col("place") > F.col("_last")).join(held.select(*key, F.col("panel_id").alias("_panel_id"), F.col("panel_area").alias("_panel_area")), key, "left")
        open_ = rest.where(F.col("_panel_id").isNull() | (better() < better("_")))
        asking = staged(open_.groupBy("panel_id").agg(F.min(F.struct("place", "panel_area", *key)).alias("x")).select("panel_id", "x.*").select(*ranked.columns), "asking")
        if not asking.limit(1).count():
            return held
