"""Connected components of a graph held in a DataFrame, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import discard, staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest node of their neighbourhood; edges are (a, b) with a > b.

    The large star moves the larger neighbours of each node, the small star the
    smaller ones and the node itself.  Minima are partial aggregates and the
    join puts one row against the edges of a hub, so a hub may be split.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        moved = edges.join(least, edges["b"] == least["u"]).select("a", F.col("m").alias("b"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = edges.join(least, edges["a"] == least["u"])
        moved = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``edges`` (columns a and b, any order).

    Rounds grow with the logarithm of a component's diameter; each is staged, so
    neither lineage nor any component meets the driver or a single task.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), label)
    mark = None
    while True:
        count, total = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if (count, total) == mark or not count:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark, before = (count, total), now
        now = staged(_stars(_stars(now, True), False), label)
        discard(before)
