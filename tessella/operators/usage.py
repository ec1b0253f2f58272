"""How often source images were used: counting, merging into the table, and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The roles that a source image can have.
ROLES = ("core", "alt", "fill")
COUNTS = tuple(f"{r}_count" for r in ROLES)


def default_counts(df: DataFrame) -> DataFrame:
    """The three counts, 0 where missing or null."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) if c in df.columns else F.lit(0).cast("long") for c in COUNTS})


def merge_counts(images: DataFrame, counts: DataFrame, key: str = "uid") -> DataFrame:
    """Counts from a checkpoint overwrite the table's where they are known; keys are compared as text, repeated ones are added up."""
    saved = sum_counts(counts.withColumn(key, F.col(key).cast("string")), key).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in COUNTS])
    joined = default_counts(images).join(saved, F.col(key).cast("string") == F.col("_key"), "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in COUNTS}).drop("_key", *[f"_{c}" for c in COUNTS])


def sum_counts(df: DataFrame, key: str = "uid") -> DataFrame:
    """A5: counts added up by key; a key without any count stays null."""
    return df.groupBy(key).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in COUNTS])


def map_legacy_counts(images: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts kept by image path, moved to uids; each image's uids get its counts."""
    uids = images.select("image", "uid").dropDuplicates(["image", "uid"])
    return sum_counts(uids.join(counts, "image", "inner"), "uid")


def add_usage(images: DataFrame, used: DataFrame, key: str = "uid") -> DataFrame:
    """Counts of a round added to the table."""
    extra = sum_counts(used, key).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in COUNTS])
    joined = default_counts(images).join(extra, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0)) for c in COUNTS}).drop("_key", *[f"_{c}" for c in COUNTS])


def layout_counts(layouts: Column) -> Column:
    """A10: how many placed images there are, in all and of each role."""
    of = lambda role: F.size(F.filter(layouts, lambda x: F.lower(x["image_type"]) == role)).cast("long")
    return F.struct(F.size(layouts).cast("long").alias("layout_count"), *[of(r).alias(f"{r}_count") for r in ROLES])


def counts_from_layouts(sidecars: DataFrame) -> DataFrame:
    """Roles by source image, from sidecars of either form."""
    placed = sidecars.select(F.explode(F.coalesce(*[c for c in ("layouts", "placements") if c in sidecars.columns])).alias("p"))
    named = [f"p.{n}" for n in ("src_img", "image") if n in placed.schema["p"].dataType.names]
    rows = placed.select(F.coalesce(*named).alias("image"), F.lower("p.image_type").alias("role")).where(F.col("image").isNotNull())
    return rows.groupBy("image").agg(*[F.count_if(F.col("role") == r).alias(f"{r}_count") for r in ROLES])


def any_usage(df: DataFrame) -> DataFrame:
    """Whether anything was used at all."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(c), F.lit(0)) for c in COUNTS])
    return df.agg((total > 0).alias("used"))


def by_role(df: DataFrame) -> DataFrame:
    """The counts as rows (role, n)."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_count").alias("n")) for r in ROLES])).alias("x")).select("x.role", "x.n")


def overview(df: DataFrame) -> DataFrame:
    """For each role, how many images were used and how the counts are spread (exact quantiles with interpolation)."""
    n = F.col("n")
    return by_role(df).groupBy("role").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(n > 0).alias("used"),
        F.count_if(n == 0).alias("unused"),
        F.sum(n).alias("sum"),
        F.avg(n).alias("mean"),
        F.median(n).alias("median"),
        F.min(n).alias("min"),
        F.max(n).alias("max"),
        F.percentile(n, 0.9).alias("p90"),
        F.percentile(n, 0.99).alias("p99"),
    )


def histogram(df: DataFrame) -> DataFrame:
    """How many images were used how often, for each role."""
    return by_role(df).groupBy("role", F.col("n").alias("count")).agg(F.count(F.lit(1)).alias("num_images"))
