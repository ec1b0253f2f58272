"""Sinks: records, metrics, summaries, sidecars, counts and settings."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Parts of a setting's name that mark it as secret.
SECRET = ("key", "token", "secret", "password")


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small file of the driver's own, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def trial_folder(output_dir: str, setting: str, dataset: str, trial: int) -> str:
    return f"{output_dir.rstrip('/')}/{setting}/{dataset}/trial_{trial}"


def document(df: DataFrame, *drop: str) -> str:
    """The one row of a table as indented JSON, without the columns that its path holds."""
    row = df.drop(*drop).select(F.to_json(F.struct("*")).alias("j")).first()
    return json.dumps(json.loads(row["j"]) if row else {}, ensure_ascii=False, indent=4)


def write_metrics(metrics: DataFrame, folder: str) -> None:
    """K1: a trial's metrics."""
    write_text(metrics.sparkSession, f"{folder}/eval_metrics.json", document(metrics, "setting", "dataset", "trial_id"))


def observed(df: DataFrame, counts: Mapping[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """A table that counts its rows (``n``, and what else is asked) while the next job runs over it."""
    seen = Observation()
    wanted = {"n": F.count(F.lit(1)), **(counts or {})}
    return df.observe(seen, *[c.alias(k) for k, c in wanted.items()]), seen


def write_records(records: DataFrame, folder: str, counts: Mapping[str, Column] | None = None) -> dict[str, int]:
    """K2: a trial's records in the order of the questions, without their numbers: one file of JSON lines.  Returns how many there are, and other counts, that came with the write."""
    rows, seen = observed(records.orderBy("sample_index"), counts)  # above the sort, which reads what is below it twice
    rows.drop("sample_index", "trial_id").write.mode("overwrite").json(f"{folder}/_eval_records")
    joined_file(records.sparkSession, f"{folder}/_eval_records", f"{folder}/eval_records.jsonl")
    return seen.get


def joined_file(spark: SparkSession, parts: str, path: str) -> None:
    """The files of a folder that Spark wrote, in their order, as one; the folder goes.  The driver passes the bytes on, it never holds a file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(parts), jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(conf)
    out = store.create(target, True)
    try:
        for name in sorted(f.getPath().toString() for f in store.listStatus(source) if f.getPath().getName().startswith("part-")):
            part = store.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()
    store.delete(source, True)


def mark_done(spark: SparkSession, folder: str) -> None:
    """K3: the mark that a trial is complete, written last."""
    write_text(spark, f"{folder}/done", "")


def write_summary(summary: DataFrame, folder: str) -> None:
    """K4: the spreads over trials."""
    write_text(summary.sparkSession, f"{folder}/summary_metrics.json", document(summary, "setting", "dataset"))


def redacted(settings: Mapping[str, object]) -> dict[str, object]:
    """Q9: settings with secrets blacked out."""
    return {k: "[redacted]" if v and any(s in k.lower() for s in SECRET) and not k.endswith("_tokens") else v for k, v in settings.items()}


def write_settings(spark: SparkSession, settings: Mapping[str, object], folder: str) -> None:
    """K5: what a run was started with, never its secrets."""
    write_text(spark, f"{folder}/args.json", json.dumps(redacted(settings), ensure_ascii=False, indent=4, default=str))


def write_sidecars(collages: DataFrame, folder: str) -> int:
    """A JSON document for each collage, in shards of a thousand; how many were written.

    A shard goes to one task, so there is one file of each, however many tasks
    the collages come from.
    """
    rows, seen = observed(collages.select((F.col("collage_index") / 1000).cast("int").alias("shard"), "collage_index", "canvas", "layouts").repartition("shard"))
    rows.write.mode("append").partitionBy("shard").json(f"{folder}/layouts")
    return seen.get["n"]


def write_counts(counts: DataFrame, folder: str, round_id: int) -> None:
    """K8: usage counts after a round, as the latest and as a checkpoint."""
    rows = counts.select("uid", "core_count", "alt_count", "fill_count")
    for name in (f"checkpoints/counts_round_{round_id}.csv", "counts_latest.csv"):
        rows.write.mode("overwrite").csv(f"{folder}/{name}", header=True, escape='"')


def write_resume(spark: SparkSession, folder: str, produced: int, next_index: int) -> None:
    """K9: where a run goes on."""
    write_text(spark, f"{folder}/resume_state.json", json.dumps({"produced_total": produced, "next_index": next_index}))


def write_final_counts(images: DataFrame, folder: str) -> None:
    """The whole image table with its final counts."""
    images.write.mode("overwrite").csv(f"{folder}/final_counts.csv", header=True, escape='"')


def report(df: DataFrame, rows: int = 20, show: Callable[[str], None] = print) -> None:
    """The first rows of a table, as text."""
    show(df._show_string(rows, False))


def logged(call: Callable, log: Callable[[dict], None] | None) -> Callable:
    """A model call that also tells an optional log what was asked and answered."""

    def wrapped(request):
        reply = call(request)
        if log:
            log({"key": request.key, "messages": len(request.messages), "choices": len(reply)})
        return reply

    return wrapped
