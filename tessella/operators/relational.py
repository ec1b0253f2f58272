"""Pools, exclusions, unions and lookups on annotation and image tables."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import numbered

log = logging.getLogger(__name__)


def pruned(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The required columns that there are; missing ones are warned about."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        log.warning("columns that are missing: %s", ", ".join(missing))
    return df.select(*[c for c in required if c in df.columns])


def valid_images(df: DataFrame) -> DataFrame:
    """Rows that name an image."""
    return df.where(F.col("image").isNotNull() & (F.col("image") != ""))


def excluding(df: DataFrame, used: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't among the used ones; rows with a null key stay."""
    return df.join(used.select(*keys).distinct(), list(keys), "left_anti")


def only(df: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """U4: rows whose keys are among the wanted ones."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, columns matched by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def latest(df: DataFrame, value: str, time: str, *keys: str) -> DataFrame:
    """Of each key, the value with the latest time; ties go to the larger value."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(time, value)).alias(value))


def lookup(df: DataFrame, key: str, entries: dict[str, str], name: str) -> DataFrame:
    """A value for each key from a small dictionary of the program's own."""
    return df.withColumn(name, F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])[F.col(key)])


def target_layouts(infos: Column, targets: Column) -> Column:
    """Layouts as (id, bbox, is_target), ids as integers, in their order."""
    entries = F.transform(F.map_entries(infos), lambda e: F.struct(e["key"].try_cast("int").alias("layout_id"), e["value"]["bbox"].alias("bbox")))
    return F.array_sort(F.transform(entries, lambda e: F.struct(e["layout_id"].alias("layout_id"), e["bbox"].alias("bbox"), F.coalesce(F.array_contains(targets, e["layout_id"]), F.lit(False)).alias("is_target"))))


def every_nth(df: DataFrame, ordinal: str, n: int = 10) -> DataFrame:
    """Every n-th row, for display."""
    return df.where(F.col(ordinal) % n == 0)


def shares_of(available: dict[str, int], weights: dict[str, int], total: int | None = None) -> dict[str, int]:
    """How many rows each source gives: whole shares of ``total`` by weight, what is left to the largest remainders (of equal ones, to the first named).

    Without a total it is the largest of which no source's exact share is more
    than it has.  A source that has fewer rows than its share is an error.
    """
    every = sum(weights.values())
    if total is None:
        total = min((available.get(s, 0) * every // w for s, w in weights.items() if w), default=0)
    out = {s: total * w // every for s, w in weights.items()}
    order = sorted(weights, key=lambda s: -(total * weights[s] % every))  # stable, so the first named stays first
    for s in order[: total - sum(out.values())]:
        out[s] += 1
    short = {s: n for s, n in out.items() if n > available.get(s, 0)}
    if short:
        raise ValueError(f"sources have fewer rows than their shares: {short}")
    return out


def mixed(sources: DataFrame, weights: dict[str, int], order: Column, total: int | None = None, column: str = "data_source") -> DataFrame:
    """Rows of several sources in exact shares, interleaved evenly; ``position`` numbers them from 0.

    ``order`` says which rows of a source are taken, and in which order: a hash of
    their key, or any other value that tells them apart.  Rows are numbered over
    the whole table in ranges, so the result doesn't depend on partitions, and
    neither a source nor the mixture is ever in one task.  Row i of a source that
    gives n has its place at (i + 1/2) / n; of equal places the source named first
    comes first.  Sources that aren't named give nothing.
    """
    named = list(weights)
    there = sources.withColumn("_source", F.array_position(F.array(*[F.lit(s) for s in named]), F.col(column))).where(F.col("_source") > 0)
    placed = numbered(there.withColumn("_order", order), "_source", "_order")
    counts = {r["_source"]: r["n"] for r in placed.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each named source
    quota = shares_of({s: counts.get(i, 0) for i, s in enumerate(named, 1)}, weights, total)
    before, starts = 0, []
    for i in range(1, len(named) + 1):
        starts.append(before)
        before += counts.get(i, 0)
    of = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), (F.col("_source") - 1).cast("int"))
    number, n = F.col("ordinal") - of(starts), of(quota.values())
    taken = placed.withColumns({"_number": number, "_n": n}).where(F.col("_number") < F.col("_n")).drop("ordinal")
    return numbered(taken.withColumn("_place", (F.col("_number") + 0.5) / F.col("_n")), "_place", "_source").withColumnRenamed("ordinal", "position").drop("_source", "_order", "_number", "_n", "_place")
