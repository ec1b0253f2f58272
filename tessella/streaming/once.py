"""Results as they complete: batches of a stream, each written once, with counts that come with the write."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import writers


def write_once(stream: DataFrame, folder: str, checkpoint: str, counts: dict[str, Column] | None = None) -> StreamingQuery:
    """K2, K3 as a stream: process what is there, batch by batch, then stop; a later call goes on.

    A batch's rows go to a folder of its number, and then its number and counts to
    the manifest.  A batch that comes again, as after a stop between the two, is
    written anew in place if the manifest hasn't got it, and not at all if it has.
    Only batches of the manifest are read (``written``).
    """

    def batch(df: DataFrame, number: int) -> None:
        spark, mark = df.sparkSession, f"{folder}/_manifest/{number}.json"
        if writers.exists(spark, mark):
            return
        seen = Observation()
        wanted = {"n": F.count(F.lit(1)), **(counts or {})}
        df.observe(seen, *[c.alias(k) for k, c in wanted.items()]).write.mode("overwrite").json(f"{folder}/records/batch={number}")
        writers.write_text(spark, mark, json.dumps({"batch": number, "counts": seen.get}))

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The batches that are complete (batch, counts)."""
    if not writers.exists(spark, f"{folder}/_manifest"):
        return spark.createDataFrame([], "batch long, counts map<string,bigint>")
    return spark.read.schema("batch long, counts map<string,bigint>").json(f"{folder}/_manifest")


def written(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The rows of complete batches; what a broken batch left is skipped by its folder's name."""
    done = manifest(spark, folder).select("batch")
    if not writers.exists(spark, f"{folder}/records"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{folder}/records").json(f"{folder}/records")
    return rows.join(done, "batch", "left_semi").drop("batch")
