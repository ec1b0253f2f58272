"""Quality classifier: regularised quadratic discriminant over document statistics.

Fitting needs only sums: for each class the number of rows, the sums of the
transformed statistics and of their products.  Executors send these for all
labelled rows that may be learnt from, in fixed point, so that they are the same
in whatever order tasks end.  Each class covariance is shrunk towards the pooled
one and then towards its mean variance; its Cholesky factor is computed once and
cached in the model that is broadcast.  A score is the logistic of the difference
of the two log-densities.

How far to shrink is chosen by folds: sums are kept for each fold, so that models
without a fold cost no pass, and their errors are counted on a bounded sample of
the labelled rows (``TUNED_ROWS``) in the fold left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .docstats import FEATURES, batches_with_counts, features
from .support import discard, shipped, smallest, staged, table, tidy

#: Weight of the pooled covariance, and of its mean variance, in a class covariance, where there are too few rows to choose.
POOLED, SPHERICAL = 0.8, 0.1
#: Log-density differences count by this factor: statistics aren't independent, nor quite normal.
TEMPER = 0.25
#: What is chosen from, the strongest first.
CHOICES = [(pooled, spherical, temper) for temper in (0.25, 0.5, 1.0) for pooled in (0.9, 0.8, 0.5, 0.2) for spherical in (0.3, 0.1, 0.03, 0.01)]
#: Documented bound: labelled rows that the choice is made on, those with the smallest hashes; and the folds.
TUNED_ROWS, FOLDS = 5_000, 5
#: Statistics are summed as whole multiples of one part in so many.
FIXED = 1024


@dataclass(frozen=True)
class Quadratic:
    """A fitted model; ``share`` is used alone where a class has too few rows."""

    share: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None  # inverse Cholesky factors, one for each class
    log_scale: np.ndarray | None = None
    temper: float = TEMPER

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for rows of transformed statistics."""
        if self.means is None:
            return np.full(len(x), self.share)
        density = []
        for mean, factor, scale in zip(self.means, self.factors, self.log_scale, strict=True):
            z = (x - mean) @ factor.T
            density.append(-0.5 * (z * z).sum(axis=1) - scale)
        odds = self.temper * (density[1] - density[0]) + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


Sums = dict[int, tuple[float, np.ndarray, np.ndarray]]


def from_sums(sums: Sums, pooled_weight: float = POOLED, spherical: float = SPHERICAL, temper: float = TEMPER) -> Quadratic:
    """The model from each class's number of rows, sums and sums of products."""
    n = np.array([sums[k][0] if k in sums else 0.0 for k in (0, 1)])
    share = (n[1] + 1) / (n.sum() + 2)
    if n.min() < 2:
        return Quadratic(share)
    means = [sums[k][1] / n[k] for k in (0, 1)]
    own = [sums[k][2] / n[k] - np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    spread = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    factors, scales = [], []
    for k in (0, 1):
        shrunk = ((1 - pooled_weight) * own[k] + pooled_weight * pooled) / np.outer(spread, spread)
        d = len(shrunk)
        shrunk = (1 - spherical) * shrunk + spherical * max(np.trace(shrunk) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.solve(lower, np.diag(1 / spread)))
        scales.append(np.log(np.diag(lower)).sum())
    return Quadratic(share, np.array(means), np.array(factors), np.array(scales), temper)


def _added(parts: Iterable[Sums]) -> Sums:
    out: Sums = {}
    for part in parts:
        for k, (n, x, xx) in part.items():
            m, y, yy = out.get(k, (0.0, 0.0, 0.0))
            out[k] = (m + n, y + x, yy + xx)
    return out


def chosen(by_fold: dict[int, Sums], fold: np.ndarray, x: np.ndarray, y: np.ndarray) -> Quadratic:
    """The model of all folds with the strongest shrinkage that takes the fewest rows for the other class, each scored without its own fold."""
    whole = _added(by_fold.values())
    if len(y) < 2 * FOLDS or y.min() == y.max():
        return from_sums(whole)
    wrong = []
    for choice in CHOICES:
        p = np.empty(len(y))
        for f in np.unique(fold):
            own = fold == f
            p[own] = from_sums(_added(s for g, s in by_fold.items() if g != f), *choice).score(x[own])
        wrong.append(int(((p >= 0.5) != y).sum()))
    return from_sums(whole, *CHOICES[int(np.argmin(wrong))])


def held_out(id_col: str) -> Column:
    """True for the rows that a label is never learnt from; a null id is not held out, but has no label either."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Quadratic:
    """Fit on every labelled row that isn't held out; rows that repeat an id or a label count each."""
    width = len(FEATURES)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("id").isNotNull() & ~held_out("id"))
    shipped(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in batches_with_counts(batches, 1):
            x = features(counts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))], ["id", "x"])

    measured = source.mapInArrow(tidy(measure), T.StructType([source.schema["id"], T.StructField("x", T.ArrayType(T.DoubleType()))]))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where(F.col("label").isin(0, 1))
    fold = F.pmod(F.xxhash64("id"), F.lit(FOLDS)).alias("fold")
    fixed = F.transform("x", lambda v: F.round(v * FIXED).cast("long")).alias("x")
    marked = staged(measured.join(known, "id").select(F.xxhash64("id").alias("hash"), "id", fold, F.col("label").cast("int").alias("label"), fixed), "quality")

    # the sums are native aggregates: no second Python worker runs in the tasks that measure
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    value = lambda i: F.get("x", F.lit(i))
    sums = [F.sum(value(i)).alias(f"s{i}") for i in range(width)] + [F.sum(value(i) * value(j)).alias(f"p{i}_{j}") for i, j in pairs]
    found: dict[int, Sums] = {}
    for r in marked.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # ten rows of some hundred numbers, whatever the input
        products = np.zeros((width, width))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"p{i}_{j}"] / FIXED**2
        found.setdefault(r["fold"], {})[r["label"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(width)], float) / FIXED, products)
    some = smallest(marked, F.col("hash"), TUNED_ROWS, "id", "label", "x").select("fold", "label", "x").collect()
    discard(marked)
    x = np.array([r["x"] for r in some], float).reshape(-1, width) / FIXED
    return chosen(found, np.array([r["fold"] for r in some]), x, np.array([r["label"] for r in some], float))


def score(docs: DataFrame, model: Quadratic, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows ``row`` (a struct of the columns ``keep``, else of all) and ``score``, without a shuffle.

    Defined cases: a null or empty text is scored like any other, by its all but
    zero statistics; other columns may have any names; an empty table gives an
    empty result.
    """
    shared = shipped(docs.sparkSession).sparkContext.broadcast(model)
    names, kept = docs.columns, [docs.columns.index(c) for c in keep or docs.columns]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    text = names.index(text_col)
    schema = T.StructType([T.StructField("row", T.StructType([source.schema["row"].dataType.fields[i] for i in kept])), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            flat = pa.RecordBatch.from_arrays([row.field(i) for i in range(len(names))], names)
            for part, counts in batches_with_counts(iter([flat]), text):
                out = pa.StructArray.from_arrays([part.column(i) for i in kept], fields=[part.schema.field(i) for i in kept])
                yield pa.RecordBatch.from_arrays([out, pa.array(shared.value.score(features(counts)))], ["row", "score"])

    return source.mapInArrow(tidy(run), schema)


def op2_qda_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labels of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, keep=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
