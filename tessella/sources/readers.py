"""Sources: annotations, records, metrics, summaries, image tables, sidecars, images and outputs."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text
from ..operators import relational, sampling, usage

log = logging.getLogger(__name__)

#: Where a trial's file lies: setting, data set and trial, from the right, as a setting may have slashes.
TRIAL_PATH = r"/(.+)/([^/]+)/trial_(\d+)/[^/]+$"
SUMMARY_PATH = r"/(.+)/([^/]+)/summary_metrics\.json$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _no_nan(df: DataFrame) -> DataFrame:
    """The bare word NaN, where a string was expected, is null."""
    return df.withColumns({f.name: F.when(F.col(f"`{f.name}`") != "NaN", F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})


def _in_file_order(df: DataFrame, name: str) -> DataFrame:
    """Numbers from 0 in the order of files, and of lines in them."""
    placed = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
    return sampling.numbered(placed, "_file", "_block", "_line").withColumnRenamed("ordinal", name).drop("_file", "_block", "_line")


def annotations(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Annotated questions from JSON lines; answers stay text, missing files raise; ``sample_index`` is the line's number."""
    read = spark.read.schema(schemas.ANNOTATION).json(path if isinstance(path, str) else list(path))
    return _no_nan(_in_file_order(read, "sample_index"))


def eval_records(spark: SparkSession, root: str) -> DataFrame:
    """All records under a folder, with the setting, data set and trial of their paths."""
    read = spark.read.schema(schemas.EVAL_RECORD).option("recursiveFileLookup", True).option("pathGlobFilter", "eval_records.jsonl").json(root)
    return _located(read, root, TRIAL_PATH)


def _located(df: DataFrame, root: str, pattern: str) -> DataFrame:
    """The parts of a file's path below the root, as columns."""
    full = F.concat(F.lit("/"), F.substring_index(F.col("_metadata.file_path"), root.rstrip("/").rpartition(":")[2].lstrip("/") + "/", -1))
    part = lambda i: F.regexp_extract(full, pattern, i)
    out = df.withColumn("setting", part(1)).withColumn("dataset", part(2))
    return out.withColumn("trial_id", part(3).cast("int")) if "trial" in pattern else out


def trial_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Every trial's metrics under a folder."""
    read = spark.read.schema(schemas.METRICS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "eval_metrics.json").json(root)
    return _located(read, root, TRIAL_PATH)


def category_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics documents as rows by category, the overall one included."""
    overall = metrics.select("setting", "dataset", "trial_id", F.lit("__overall__").alias("category"), F.col("overall_success_rate").alias("success_rate"), F.col("overall_completion_rate").alias("completion_rate"), F.col("overall_accuracy").alias("accuracy"))
    each = metrics.select("setting", "dataset", "trial_id", F.explode("category_accuracy").alias("category", "accuracy"), "category_success_rate", "category_completion_rate")
    return overall.unionByName(each.select("setting", "dataset", "trial_id", "category", F.col("category_success_rate")[F.col("category")].alias("success_rate"), F.col("category_completion_rate")[F.col("category")].alias("completion_rate"), "accuracy"))


def summaries(spark: SparkSession, root: str) -> DataFrame:
    """Every summary under a folder; settings without one are simply not there."""
    read = spark.read.schema(schemas.SUMMARY).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary_metrics.json").json(root)
    found = _located(read, root, SUMMARY_PATH)
    spreads = [F.col(f"overall_{m}.{s}").alias(f"{m}_{s}") for m in ("success_rate", "completion_rate", "accuracy") for s in ("mean", "std")]
    return found.select("setting", "dataset", F.coalesce("num_trials", F.lit(1)).alias("num_trials"), *spreads, "category_accuracy")


def image_tables(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str] | None = None, hashed_uid: bool = False) -> DataFrame:
    """Image tables from CSV files, one under the other, with counts and a uid.

    Quoted line feeds and doubled quotes are read as other tools write them, and
    the usual words for missing values are null.  The uid is the row's number in
    the order of the files; with ``hashed_uid`` it is a hash of the image's path,
    which doesn't change when files are added.
    """
    frames = []
    for p in [paths] if isinstance(paths, str) else paths:
        df = spark.read.csv(p, header=True, escape='"', multiLine=True)
        missing = ["", "NA", "N/A", "NaN", "nan", "None", "null", "NULL"]
        df = df.withColumns({c: F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`")) for c in df.columns})
        types = {f.name: f.dataType for f in schemas.SOURCE_IMAGE.fields}
        df = df.withColumns({c: F.col(c).try_cast(types[c]) for c in df.columns if c in types})
        frames.append(_in_file_order(relational.pruned(df, required) if required else df, "_row").withColumn("_nth", F.lit(len(frames))))
    every = usage.default_counts(relational.union_all(frames))
    if hashed_uid:
        return every.withColumn("uid", F.hex(F.xxhash64("image"))).drop("_row", "_nth")
    return sampling.numbered(every, "_nth", "_row").withColumn("uid", F.col("ordinal").cast("string")).drop("_row", "_nth", "ordinal")


def counts(spark: SparkSession, path: str) -> DataFrame:
    """S3: usage counts from CSV, by uid or, in older files, by image."""
    df = spark.read.csv(path, header=True, escape='"', multiLine=True)
    return usage.default_counts(df)


def sidecars(spark: SparkSession, root: str, lines: bool = False) -> DataFrame:
    """Canvases and their layouts under a folder, in the present or the earlier form; unreadable ones are left out.

    A file holds one document, or with ``lines`` one on each line, as this engine writes them.
    """
    read = spark.read.schema(T.StructType([*schemas.SIDECAR.fields, T.StructField("_corrupt_record", T.StringType())])).option("multiLine", not lines).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").json(root)
    found = read.select("*", F.col("_metadata.file_path").alias("path")).where(F.col("_corrupt_record").isNull() & F.coalesce("layouts", "placements").isNotNull())
    side = lambda name: F.coalesce(F.col(f"canvas.{name}"), F.col(name)).alias(name)
    return found.select("path", *[side(c) for c in ("width", "height", "grid", "margin_g")], F.coalesce("layouts", "placements").alias("layouts"))


def output_index(spark: SparkSession, root: str) -> DataFrame:
    """The largest number among the rendered images and how many there are; -1 and 0 if none.  Only paths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    number = F.when(text.extension(F.col("path")).isin(".jpg", ".png"), text.integer_stem(F.col("path")))
    return files.agg(F.coalesce(F.max(number), F.lit(-1)).cast("long").alias("max_index"), F.count(number).alias("n"))


def images(spark: SparkSession, root: str, decoded: bool = False) -> DataFrame:
    """Image files, as bytes or decoded by Spark."""
    return spark.read.format("image" if decoded else "binaryFile").option("recursiveFileLookup", True).load(root)


def resolved_images(paths: DataFrame, listing: DataFrame, path: str = "image") -> DataFrame:
    """Each path, or the first with another usual extension that there is; null if there is none."""
    tried = paths.select(F.col(path).alias("_wanted")).distinct().select("_wanted", F.posexplode(text.image_candidates(F.col("_wanted"))).alias("_nth", "_try"))
    found = tried.join(listing.select(F.col("path").alias("_try")).distinct(), "_try").groupBy("_wanted").agg(F.min_by("_try", "_nth").alias("found"))
    return paths.join(found, F.col(path) == F.col("_wanted"), "left").drop("_wanted")


def done_trials(spark: SparkSession, root: str) -> DataFrame:
    """The trials of a data set's folder that have their mark, also of tables written by Spark.  Marks are empty, so they are listed, not read."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/trial_*/{{done,_SUCCESS}}")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    ids = {name.rpartition("_")[2].rpartition("=")[2] for name in (f.getPath().getParent().getName() for f in found)}
    return spark.createDataFrame([(int(i),) for i in sorted(ids) if i.isdigit()], "trial_id int")


def training_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Training rows from several Parquet files."""
    return spark.read.schema(schemas.TRAINING).parquet(*paths)


def newest(files: DataFrame) -> Column:
    """The path modified last."""
    return F.max_by("path", F.struct("modificationTime", "path"))


def latest_counts(spark: SparkSession, folder: str) -> str | None:
    """The counts to go on from: the final ones, else the latest, else the newest checkpoint."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path", "modificationTime")
    except Exception as e:  # the folder isn't there yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    # a table is one file, or a folder of parts
    whole = F.regexp_extract("path", r"^(.*/(?:final_counts|counts_latest|checkpoints/[^/]+)\.csv)(?:/[^/]*)?$", 1)
    files = files.withColumn("path", whole)
    kind = F.when(F.col("path").endswith("/final_counts.csv"), 2).when(F.col("path").endswith("/counts_latest.csv"), 1).when(F.contains(F.col("path"), F.lit("/checkpoints/")), 0)
    best = files.withColumn("kind", kind).where(F.col("kind").isNotNull()).agg(F.max_by("path", F.struct("kind", "modificationTime", "path")).alias("path")).first()
    return best["path"]
