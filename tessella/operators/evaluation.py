"""Outcomes of evaluated questions: classification, rates, spreads over trials, and the matrix of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

OVERALL = "__overall__"
#: The outcomes that are counted.
OUTCOMES = ("correct", "wrong", "incomplete", "invalid")


def with_aliases(df: DataFrame) -> DataFrame:
    """``image`` or else ``file_name``; ``category``, or else ``subset``, or else ``unknown``."""
    have = lambda *names: [F.col(n) for n in names if n in df.columns]
    return df.withColumns({"image": F.coalesce(*have("image", "file_name"), F.lit(None).cast("string")), "category": F.coalesce(*have("category", "subset"), F.lit("unknown"))})


def status(success: Column, is_correct: Column, inferred: Column, finish_reason: Column) -> Column:
    """The outcome of one result.

    A success is correct or wrong.  Otherwise it is incomplete if the model
    answered but didn't stop by itself, and invalid in all other cases.
    """
    return (
        F.when(F.coalesce(success, F.lit(False)), F.when(F.coalesce(is_correct, F.lit(False)), "correct").otherwise("wrong"))
        .when(F.coalesce(inferred, F.lit(False)) & ~F.coalesce(finish_reason == "stop", F.lit(False)), "incomplete")
        .otherwise("invalid")
    )


def record_status(result: Column) -> Column:
    """P16 on an ``eval_result`` struct."""
    return status(result["success"], result["is_correct"], result["inference_result"]["success"], result["inference_result"]["finish_reason"])


def rates(df: DataFrame) -> DataFrame:
    """A3: success, completion and accuracy from the counts; a rate without a base is 0."""
    done = F.col("correct") + F.col("wrong")
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.withColumns({"success_rate": over(done, F.col("total")), "completion_rate": over(done, done + F.col("incomplete")), "accuracy": over(F.col("correct"), F.col("total"))})


def rollup(df: DataFrame, *keys: str, category: str = "category", outcome: str = "status") -> DataFrame:
    """A1, A2, A3: counts by category and overall in one pass, and their rates.  ``keys`` (a trial, a setting) are kept apart."""
    counts = [F.count_if(F.col(outcome) == k).alias(k) for k in OUTCOMES] + [F.count(F.lit(1)).alias("total")]
    named = df.withColumn(category, F.coalesce(F.col(category), F.lit("unknown")))
    sets = [[*keys, category], [*keys]]
    grouped = named.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keys, category)]).agg(*counts)
    return rates(grouped.withColumn(category, F.coalesce(F.col(category), F.lit(OVERALL))))


def over_trials(metrics: DataFrame, *keys: str, trial: str = "trial_id", values: tuple[str, ...] = ("success_rate", "completion_rate", "accuracy")) -> DataFrame:
    """A4: means and population deviations over the trials that have the category."""
    spreads = [f(F.col(v)).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return metrics.groupBy(*keys).agg(F.count_distinct(trial).alias("num_trials"), *spreads)


def metrics_document(rolled: DataFrame, *keys: str, category: str = "category") -> DataFrame:
    """M8: one struct of rates and counts for each trial, with categories as map keys."""
    stats = F.map_from_arrays(F.array(*[F.lit(k) for k in (*OUTCOMES, "total")]), F.array(*[F.col(k) for k in (*OUTCOMES, "total")]))
    is_all = F.col(category) == OVERALL
    by = lambda v: F.map_from_entries(F.array_sort(F.collect_list(F.when(~is_all, F.struct(F.col(category), v)))))
    names = {"success_rate": "success_rate", "completion_rate": "completion_rate", "accuracy": "accuracy"}
    # maps can't be ordered, so the counts go into the list behind their category
    counts = F.map_from_entries(F.collect_list(F.when(~is_all, F.struct(F.col(category), stats.alias("v")))))
    return rolled.groupBy(*keys).agg(
        *[F.max(F.when(is_all, F.col(c))).alias(f"overall_{n}") for n, c in names.items()],
        F.first(F.when(is_all, stats), ignorenulls=True).alias("overall_stats"),
        *[by(F.col(c).alias("v")).alias(f"category_{n}") for n, c in names.items()],
        counts.alias("category_stats"),
    )


def summary_document(spreads: DataFrame, *keys: str, category: str = "category") -> DataFrame:
    """M9: one struct of spreads for each setting and dataset."""
    is_all = F.col(category) == OVERALL
    spread = lambda n: F.struct(F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_std").alias("std"))
    names = ("success_rate", "completion_rate", "accuracy")
    return spreads.groupBy(*keys).agg(
        F.max(F.when(is_all, F.col("num_trials"))).cast("int").alias("num_trials"),
        *[F.first(F.when(is_all, spread(n)), ignorenulls=True).alias(f"overall_{n}") for n in names],
        *[F.map_from_entries(F.array_sort(F.collect_list(F.when(~is_all, F.struct(F.col(category), spread(n).alias("v")))))).alias(f"category_{n}") for n in names],
    )


def matrix(grid: DataFrame, summaries: DataFrame, datasets: list[str]) -> DataFrame:
    """A row for each setting and a column for each dataset; ``N/A`` where there is no summary.

    ``grid`` has the settings and datasets asked for; ``summaries`` has
    accuracy_mean, accuracy_std and num_trials for those that there are.
    """
    cell = F.coalesce(text.spread(F.col("accuracy_mean"), F.col("accuracy_std"), F.col("num_trials")), F.lit("N/A"))
    cells = grid.join(summaries, ["setting", "dataset"], "left").withColumn("cell", cell)
    return cells.groupBy("setting").pivot("dataset", datasets).agg(F.first("cell"))


def shortfalls(summaries: DataFrame) -> DataFrame:
    """Settings whose success or completion is below 1."""
    return summaries.where((F.col("success_rate_mean") < 1) | (F.col("completion_rate_mean") < 1))


def trials_to_run(planned: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Planned trials that haven't been done."""
    return planned.join(done.select(*keys).distinct(), list(keys), "left_anti")


def zipped(keys: Column, values: Column) -> Column:
    """Two arrays joined by position; it is an error if their lengths differ."""
    return F.when(F.size(keys) == F.size(values), F.arrays_zip(keys, values)).otherwise(F.raise_error(F.lit("arrays of different lengths")))


def first_success_by(df: DataFrame, key: str, value: str, order: str, success: Column) -> DataFrame:
    """A16 over rows: of each key, the value of its first row that succeeded (null if none did) and how many rows there are, without collecting them."""
    return df.groupBy(key).agg(F.min_by(F.when(success, F.col(value)), F.when(success, F.col(order))).alias("first_value"), F.count(F.lit(1)).alias("results"))


def first_success(results: Column) -> Column:
    """The first result that succeeded, null if none did."""
    return F.get(F.filter(results, lambda r: F.coalesce(r["success"], F.lit(False))), F.lit(0))
