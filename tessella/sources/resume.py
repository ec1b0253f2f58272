"""Checkpoints of collage runs, and going on from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import collage, usage
from . import readers, writers
from .checkpoints import staged


def checkpoint(images: DataFrame, folder: str, round_id: int, produced: int, next_index: int) -> None:
    """Counts and state after a round."""
    writers.write_counts(images, folder, round_id)
    writers.write_resume(images.sparkSession, folder, produced, next_index)


def _from_sidecars(images: DataFrame, folder: str) -> DataFrame:
    """Counts from the layouts that were written, moved from images to uids."""
    spark = images.sparkSession
    layouts = readers.sidecars(spark, f"{folder}/layouts", lines=True)
    return usage.merge_counts(images, usage.map_legacy_counts(images.select("image", F.col("uid").cast("string").alias("uid")), usage.counts_from_layouts(layouts)))


def _layouts(spark: SparkSession, folder: str) -> DataFrame | None:
    """The collages whose layouts were written, null where none were."""
    if not writers.exists(spark, f"{folder}/layouts"):
        return None
    return spark.read.schema(collage.COLLAGE).option("recursiveFileLookup", True).json(f"{folder}/layouts")


def made(spark: SparkSession, folder: str) -> int:
    """How many collages an earlier run made, whatever their numbers."""
    layouts = _layouts(spark, folder)
    return layouts.select("collage_index").distinct().count() if layouts else 0


def unrendered(spark: SparkSession, folder: str) -> DataFrame:
    """The collages that have layouts, but no image yet."""
    layouts = _layouts(spark, folder)
    if layouts is None:
        return spark.createDataFrame([], collage.COLLAGE)
    if not writers.exists(spark, f"{folder}/images"):
        return layouts
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg}").load(f"{folder}/images").select(text.integer_stem(F.col("path")).alias("collage_index"))
    return staged(layouts.join(files, "collage_index", "left_anti"), "unrendered")


def next_index(spark: SparkSession, folder: str) -> int:
    """One more than the largest number among the images, or among the layouts where no images are rendered."""
    found = -1
    if writers.exists(spark, f"{folder}/images"):
        found = readers.output_index(spark, f"{folder}/images").first()["max_index"]
    if writers.exists(spark, f"{folder}/layouts"):
        made = spark.read.schema("collage_index long").option("recursiveFileLookup", True).json(f"{folder}/layouts")
        found = max(found, made.agg(F.coalesce(F.max("collage_index"), F.lit(-1))).first()[0])
    return found + 1


def prepare(images: DataFrame, folder: str, counts_path: str | None = None) -> tuple[DataFrame, int]:
    """The image table with the counts of the last checkpoint, and the next index.

    Counts by image path are moved to uids.  Where there is no checkpoint, or
    nothing was counted in it, counts come from the layouts that were written.
    """
    spark = images.sparkSession
    path = counts_path or (readers.latest_counts(spark, folder) if writers.exists(spark, folder) else None)
    out, loaded = images, False
    if path:
        saved = readers.counts(spark, path)
        if "uid" not in saved.columns:
            saved = usage.map_legacy_counts(images.select("image", F.col("uid").cast("string").alias("uid")), saved)
        out = usage.merge_counts(images, saved)
        loaded = bool(usage.any_usage(out).first()["used"])
    if not loaded and writers.exists(spark, f"{folder}/layouts"):
        out = _from_sidecars(images, folder)
    return usage.default_counts(out), next_index(spark, folder)
