"""Streams of evaluation records and of uses (an extension: the batch operators, kept up to date as files arrive)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schemas
from ..operators import evaluation, usage
from ..sources.checkpoints import shipped


def records(spark: SparkSession, folder: str, files_per_trigger: int = 128) -> DataFrame:
    """Records as they are written; the bound on files a trigger holds back what the model's service can't take."""
    return spark.readStream.schema(schemas.EVAL_RECORD).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def running_rates(stream: DataFrame) -> DataFrame:
    """Counts by category and overall, kept by partial aggregates in the state store."""
    named = evaluation.with_aliases(stream).withColumn("status", evaluation.record_status(F.col("eval_result")))
    both = named.select(F.explode(F.array("category", F.lit(evaluation.OVERALL))).alias("category"), "status")
    counts = [F.count_if(F.col("status") == k).alias(k) for k in evaluation.OUTCOMES] + [F.count(F.lit(1)).alias("total")]
    return evaluation.rates(both.groupBy("category").agg(*counts))


def windowed_outcomes(events: DataFrame, time: str, category: str, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts in windows of event time; rows later than the watermark are left to the batch run."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), category).agg(F.count(F.lit(1)).alias("n"))


def write_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete", name: str = "rates") -> StreamingQuery:
    """Process what is there, then stop; a later call goes on from the checkpoint."""

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{name}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def running_usage(used: DataFrame) -> DataFrame:
    """D18 as a stream: the uses of each image so far, in keyed state; ``used`` has uid and role."""
    shipped(used.sparkSession)

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = list(state.get) if state.exists else [0, 0, 0]
        for frame in frames:
            for i, role in enumerate(usage.ROLES):
                now[i] += int((frame["role"] == role).sum())
        state.update(tuple(now))
        yield pd.DataFrame({"uid": [key[0]], **{c: [n] for c, n in zip(usage.COUNTS, now, strict=True)}})

    fields = ", ".join(f"{c} long" for c in usage.COUNTS)
    return used.groupBy("uid").applyInPandasWithState(count, f"uid string, {fields}", fields, "update", GroupStateTimeout.NoTimeout)
