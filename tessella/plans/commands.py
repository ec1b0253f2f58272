"""Whole runs: evaluate a model, gather results, make collages.

``python -m tessella.plans.commands evaluate|gather|collages --help``
"""

from __future__ import annotations

import argparse
import importlib.util
import json
import logging
import os
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import collage, evaluation, inference, rendering
from ..sources import readers, resume, sink, writers
from ..sources.checkpoints import shipped, staged

log = logging.getLogger(__name__)


def evaluate(spark: SparkSession, samples: DataFrame, main: inference.Backend, judge: inference.Backend, output_dir: str, setting: str, dataset: str, num_trials: int = 1, settings: dict | None = None, **options) -> DataFrame:
    """Evaluate the trials that aren't done, write each, then summarise all of them.

    A trial's mark is written last, so a trial that was broken off runs again;
    what the model had answered by then is in the journal ``_calls`` and isn't
    asked again (``journal=None`` keeps none).  Counts come with the write of the
    records.  The summary is made anew even if all trials were done before.
    """
    if num_trials <= 0:
        raise ValueError("the number of trials must be positive")
    root = f"{output_dir.rstrip('/')}/{setting}/{dataset}"
    folders = {t: writers.trial_folder(output_dir, setting, dataset, t) for t in range(num_trials)}
    left = [t for t, f in folders.items() if not writers.exists(spark, f"{f}/done")]
    if settings is not None:
        writers.write_settings(spark, settings, root)
    named = evaluation.with_aliases(samples)
    options.setdefault("journal", f"{root}/_calls")
    if left:
        records = staged(inference.evaluate(named, main, judge, left, **options), "records")
        counted = evaluation.rollup(records.withColumn("status", evaluation.record_status(F.col("eval_result"))), "trial_id")
        documents = staged(evaluation.metrics_document(counted, "trial_id"), "metrics")
        for t in left:
            writers.write_metrics(documents.where(F.col("trial_id") == t), folders[t])
            outcome = evaluation.record_status(F.col("eval_result"))
            seen = writers.write_records(records.where(F.col("trial_id") == t), folders[t], {k: F.count_if(outcome == k) for k in evaluation.OUTCOMES})
            log.info("trial %s of %s on %s: %s", t, setting, dataset, ", ".join(f"{v} {k}" for k, v in seen.items()))
            writers.mark_done(spark, folders[t])
    summary = summarise(spark, output_dir).where((F.col("setting") == setting) & (F.col("dataset") == dataset))
    writers.write_summary(summary, root)
    return summary


def summarise(spark: SparkSession, output_dir: str) -> DataFrame:
    """D3: means and deviations over all trials under a folder."""
    spreads = evaluation.over_trials(readers.category_metrics(readers.trial_metrics(spark, output_dir)), "setting", "dataset", "category")
    return evaluation.summary_document(spreads, "setting", "dataset")


def gather(spark: SparkSession, output_dir: str, settings: Sequence[str], datasets: Sequence[str]) -> DataFrame:
    """The matrix of settings and data sets; with a single data set also its categories."""
    grid = spark.createDataFrame([(s, d) for s in settings for d in datasets], "setting string, dataset string")
    found = readers.summaries(spark, output_dir)
    out = evaluation.matrix(grid, found, list(datasets))
    if len(datasets) == 1:
        each = found.where(F.col("dataset") == datasets[0]).select("setting", "num_trials", F.explode("category_accuracy").alias("category", "s"))
        cells = each.select("setting", F.concat(F.lit(f"{datasets[0]}-"), F.col("category")).alias("category"), text.spread(F.col("s.mean"), F.col("s.std"), F.col("num_trials")).alias("cell"))
        out = out.join(cells.groupBy("setting").pivot("category").agg(F.first("cell")), "setting", "left")
    return out


def sweep(spark: SparkSession, models: dict[str, inference.Backend], datasets: dict[str, DataFrame], judge: inference.Backend, output_dir: str, num_trials: int = 1, by_model: dict[str, dict] | None = None, **options) -> DataFrame:
    """Evaluate every model on every data set, then gather.

    ``by_model`` has options for models whose name contains a part, such as a
    bound on pixels; later parts win.
    """
    for name, backend in models.items():
        own = dict(options)
        for part, more in (by_model or {}).items():
            own |= more if part in name.lower() else {}
        for dataset, samples in datasets.items():
            evaluate(spark, samples, backend, judge, output_dir, name, dataset, num_trials, **own)
    return gather(spark, output_dir, list(models), list(datasets))


def local_path(path: Column) -> Column:
    """A path as it was given, without the scheme that Spark puts before local ones."""
    return F.regexp_replace(path, "^file:/+", "/")


#: Images that are decoded by Spark in one go; their paths are all that the driver holds.
BLOCK = 256


def with_images(samples: DataFrame, path: Column, max_pixels: int | None, block: int = BLOCK) -> DataFrame:
    """Where each question's image comes from; only files that are named are opened.

    Images are read in the tasks that send them (``image_path``).  Those above the
    bound on pixels have to be decoded to be resized; where Pillow is missing,
    Spark does it (``image_data``), ``block`` files at a time, whose questions are
    broadcast, so no pixels are shuffled.
    """
    spark = shipped(samples.sparkSession)
    named = samples.withColumn("image_path", path)
    if not max_pixels or importlib.util.find_spec("PIL"):
        return named

    def large(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for p in frame["image_path"]:
                try:
                    sides = inference.image_sides(inference.opened(p))
                except OSError:
                    sides = None
                if sides and sides[0] * sides[1] > max_pixels:
                    found.append(p)
            yield pd.DataFrame({"image_path": found})

    paths = staged(named.select("image_path").where(F.col("image_path").isNotNull()).distinct().mapInPandas(large, "image_path string"), "large")
    out = named.join(paths, "image_path", "left_anti")
    waiting = [r["image_path"] for r in paths.limit(block).collect()]
    while waiting:
        now = spark.createDataFrame([(p,) for p in waiting], "image_path string")
        asked = named.join(F.broadcast(now), "image_path", "left_semi")
        pixels = spark.read.format("image").load(waiting).select(local_path(F.col("image.origin")).alias("_origin"), F.col("image").alias("image_data"))
        decoded = pixels.join(F.broadcast(asked.withColumn("_origin", local_path(F.col("image_path")))), "_origin").drop("_origin", "image_path")
        out = out.unionByName(decoded, allowMissingColumns=True)
        paths = paths.join(F.broadcast(now), "image_path", "left_anti")
        waiting = [r["image_path"] for r in paths.limit(block).collect()]
    return out


def render(spark: SparkSession, made: DataFrame, folder: str, image_root: str, edges: bool = False, boxes: bool = False) -> int:
    """K6, K7: the collages' images, each with its sidecar, written to the folder together or not at all; the number of images.

    Only source images that the collages name are decoded; their paths, some
    tens for each collage of a round, pass through the driver.
    """
    named = made.select(F.explode("layouts.src_img").alias("src")).where(F.col("src").isNotNull()).distinct().withColumn("path", text.joined_path(F.lit(image_root), F.col("src")))
    there = readers.images(spark, image_root).select(local_path(F.col("path")).alias("path"))
    paths = {r["path"]: r["src"] for r in named.join(there, "path", "left_semi").collect()}
    images = spark.createDataFrame([], rendering.DECODED)
    if paths:
        images = spark.read.format("image").load(list(paths)).select(local_path(F.col("image.origin")).alias("path"), "image")
        images = named.select("src", "path").join(images, "path").select(F.col("src").alias("path"), "image")
    files, seen = rendering.render(made, images, edges, boxes).select("path", "content"), Observation()
    sink.write_files(files.unionByName(sink.sidecar_files(made)).observe(seen, F.count_if(F.col("path").endswith(".png")).alias("n")), folder)
    return seen.get["n"]


def collages(spark: SparkSession, images: DataFrame, folder: str, total: int, per_round: int, chunks: int, seed: int = 42, settings: collage.Settings | None = None, auto_resume: bool = True, checkpoint_each_round: bool = True, image_root: str | None = None, edges: bool = False, boxes: bool = False) -> DataFrame:
    """Make collages in rounds until there are ``total``, write layouts, counts and (with ``image_root``) images after each, and go on from an earlier run.

    An earlier run counts by the collages it made, not by their numbers, which
    may have gaps.  Layouts whose image a broken run didn't get to are rendered first.
    """
    start, done, last = 0, 0, images
    if auto_resume:
        images, start = resume.prepare(images, folder)
        done, last = resume.made(spark, folder), images
        if image_root and done:
            render(spark, resume.unrendered(spark, folder), folder, image_root, edges, boxes)
    for round_id, made, last in collage.make_all(images, max(0, total - done), per_round, chunks, seed, settings, start):
        done += writers.write_sidecars(made, folder)
        if image_root:
            render(spark, made, folder, image_root, edges, boxes)
        if checkpoint_each_round:
            resume.checkpoint(last, folder, round_id, done, resume.next_index(spark, folder))
    writers.write_final_counts(last, folder)
    return last


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessella")
    sub = parser.add_subparsers(dest="command", required=True)
    e = sub.add_parser("evaluate")
    for name in ("eval_name", "ann_file", "img_dir", "model", "api_base_url", "judge_api_base_url"):
        e.add_argument(f"--{name}", required=True)
    e.add_argument("--api_key_variable", default="OPENAI_API_KEY", help="environment variable that holds the model's key")
    e.add_argument("--judge_api_key_variable", default="JUDGE_API_KEY")
    e.add_argument("--setting", default=None)
    e.add_argument("--img_max_pixels", type=int, default=3500 * 3500)
    e.add_argument("--sys_prompt", choices=["model_default", "think"], default="model_default")
    e.add_argument("--chat_completion_kwargs", type=json.loads, default={"max_completion_tokens": 16384})
    e.add_argument("--client_timeout", type=float, default=None)
    e.add_argument("--image_url_extra_settings", type=json.loads, default={"detail": "high"})
    e.add_argument("--judge_model", default="gpt-5-nano")
    e.add_argument("--output_dir", default="./outputs/eval")
    e.add_argument("--num_trials", type=int, default=1)
    e.add_argument("--concurrency", type=int, default=128)
    e.add_argument("--max_answer_length", type=int, default=1000)
    e.add_argument("--separate_trial_requests", action="store_true")
    g = sub.add_parser("gather")
    g.add_argument("--settings", nargs="+", required=True)
    g.add_argument("--datasets", nargs="+", required=True)
    g.add_argument("--output_dir", default="./outputs/eval")
    c = sub.add_parser("collages")
    c.add_argument("--csv", nargs="+", required=True)
    c.add_argument("--save_dir", required=True)
    c.add_argument("--image_root", default=None, help="folder of the source images; collages are rendered if it is given")
    for name, value in (("total_count", 100), ("per_round_per_proc", 5), ("n_proc", 4), ("seed", 42)):
        c.add_argument(f"--{name}", type=int, default=value)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"tessella-{a.command}").getOrCreate()
    if a.command == "gather":
        writers.report(gather(spark, os.path.abspath(a.output_dir), a.settings, a.datasets), 1000)
    elif a.command == "collages":
        images = readers.image_tables(spark, a.csv)
        collages(spark, images, os.path.abspath(a.save_dir), a.total_count, a.per_round_per_proc * a.n_proc, a.n_proc, a.seed, image_root=a.image_root and os.path.abspath(a.image_root))
    else:
        if "n" in a.chat_completion_kwargs:
            parser.error("the number of choices follows from the trials")
        samples = evaluation.with_aliases(readers.annotations(spark, a.ann_file))
        samples = with_images(samples, text.joined_path(F.lit(os.path.abspath(a.img_dir)), F.col("image")), a.img_max_pixels or None)
        model = inference.Retrying(inference.HttpBackend(a.model, a.api_base_url, a.api_key_variable, a.client_timeout or 600.0))
        judge = inference.Retrying(inference.HttpBackend(a.judge_model, a.judge_api_base_url, a.judge_api_key_variable))
        options = {"system_prompt": text.THINK_PROMPT if a.sys_prompt == "think" else None, "call_settings": a.chat_completion_kwargs, "image_settings": a.image_url_extra_settings, "max_pixels": a.img_max_pixels or None}
        options |= {"max_answer_length": a.max_answer_length, "separate": a.separate_trial_requests, "concurrency": a.concurrency, "in_flight": a.concurrency}
        evaluate(spark, samples, model, judge, os.path.abspath(a.output_dir), a.setting or a.model, a.eval_name, a.num_trials, vars(a), **options)


if __name__ == "__main__":
    main()
