"""Quality rules: base rules on word counts, then gradient-boosted trees over document statistics.

The trees are grown on the driver from a bounded sample of labelled statistics
(``MOST_ROWS`` rows, those with the smallest hashes; copies count as often as they stand), flattened into arrays of
nodes and broadcast; executors walk all rows of a batch through a tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .docstats import COUNTS, FEATURES, batches_with_counts, features
from .support import discard, shipped, smallest, staged, table, tidy

#: Documented bound: labelled rows that the trees are grown from, and rows of documents with their ids that differ in label or statistics.
MOST_ROWS = 20_000
#: Growing: trees, levels, step, bins of a statistic, least curvature of a leaf, and its penalty.
TREES, LEVELS, STEP, BINS, LEAST, PENALTY = 80, 3, 0.2, 32, 2.0, 1.0
#: Statistics in which the score may only fall: repetition and symbols never make a text better.
MONOTONE = {"repeat_share": -1, "dup_line_share": -1, "symbol_rate": -1, "echo_share": -1, "shout_rate": -1}
#: Base rules: the fewest words, and the largest share of repeated words in percent.
FEWEST_WORDS, MOST_REPEATED = 20, 30


@dataclass(frozen=True)
class Forest:
    """All trees' nodes one after another; a leaf is its own child."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    levels: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.levels):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def _quantiles(v: np.ndarray, times: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Quantiles of the values, each of them standing so many times."""
    order = np.argsort(v, kind="stable")
    ends, place = np.cumsum(times[order]), shares * (times.sum() - 1)
    below, above = (v[order][np.searchsorted(ends, whole, "right")] for whole in (np.floor(place), np.ceil(place)))
    return below + (above - below) * (place - np.floor(place))


def grow(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, times: np.ndarray | None = None) -> Forest:
    """Boost trees on the logistic loss; each row counts ``times`` times, or once.

    A split on a statistic with a direction is taken only if its two values go
    that way; both children are then bound by the middle of them, so the whole
    tree, and the sum of all trees, is monotone in it.  With one class missing
    there is nothing to split and the score is the smoothed share of label 1.
    """
    times = np.ones(len(y)) if times is None else times
    share = ((times * y).sum() + 1) / (times.sum() + 2)
    start = float(np.log(share / (1 - share)))
    edges = [np.unique(_quantiles(x[:, j], times, np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, x.shape[1]), int)
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    margin = np.full(len(y), start)
    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = times * (y - p), times * np.maximum(p * (1 - p), 1e-9)
        roots.append(len(nodes))
        nodes.append([0, np.inf, 0, 0, 0])
        waiting = [(len(nodes) - 1, np.arange(len(y)), 0, -np.inf, np.inf)]
        while waiting:
            at, rows, level, low, high = waiting.pop()
            g, h = slope[rows].sum(), curve[rows].sum()
            value = float(np.clip(g / (h + PENALTY), low, high))
            best = (1e-6, None)
            for j, e in enumerate(edges) if level < LEVELS else ():
                if not len(e):
                    continue
                gl = np.cumsum(np.bincount(bins[rows, j], slope[rows], minlength=len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, j], curve[rows], minlength=len(e) + 1))[:-1]
                vl, vr = np.clip(gl / (hl + PENALTY), low, high), np.clip((g - gl) / (h - hl + PENALTY), low, high)
                gain = gl**2 / (hl + PENALTY) + (g - gl) ** 2 / (h - hl + PENALTY) - g**2 / (h + PENALTY)
                gain[(hl < LEAST) | (h - hl < LEAST) | (monotone[j] * (vr - vl) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    k = int(gain.argmax())
                    best = (float(gain[k]), (j, k, float(vl[k]), float(vr[k])))
            if best[1] is None:
                nodes[at] = [0, np.inf, at, at, STEP * value]
                margin[rows] += STEP * value
                continue
            j, k, vl, vr = best[1]
            middle, goes_left = (vl + vr) / 2, bins[rows, j] <= k
            bounds = {0: [(low, high)] * 2, 1: [(low, middle), (middle, high)], -1: [(middle, high), (low, middle)]}[int(monotone[j])]
            nodes[at] = [j, edges[j][k], len(nodes), len(nodes) + 1, 0]
            for side, bound in zip((goes_left, ~goes_left), bounds, strict=True):
                waiting.append((len(nodes), rows[side], level + 1, *bound))
                nodes.append([0, np.inf, 0, 0, 0])
    table_ = np.array(nodes or [[0, np.inf, 0, 0, 0]], float)
    whole = lambda i: table_[:, i].astype(np.int64)
    return Forest(start, np.array(roots, np.int64), whole(0), table_[:, 1], whole(2), whole(3), table_[:, 4], LEVELS)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_rows: int = MOST_ROWS) -> Forest:
    """Grow the trees from at most ``most_rows`` labelled rows, those whose id has the smallest hash; ids that are held out by the hash rule of the quality classifier aren't used."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = smallest(known.where(F.crc32(F.col("id").cast("string")) % 3 != 1), F.xxhash64("id"), most_rows, "id", "label")
    shipped(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    marked = texts.join(F.broadcast(known), "id").select("label", "text")  # broadcast: at most ``most_rows`` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in batches_with_counts(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *map(pa.array, features(counts).T)], ["label", *FEATURES])

    rows = marked.mapInArrow(tidy(run), "label long, " + ", ".join(f"{f} double" for f in FEATURES))
    alike = staged(rows.groupBy(*rows.columns).agg(F.count("*").alias("times")), "boosting")
    # ids repeat in documents: in the order of label and statistics one class or length would be cut first
    data = np.array([tuple(r) for r in smallest(alike, F.xxhash64(*rows.columns), most_rows, *rows.columns).collect()], float).reshape(-1, 2 + len(FEATURES))
    discard(alike)
    return grow(data[:, 1:-1], data[:, 0], np.array([MONOTONE.get(f, 0) for f in FEATURES]), data[:, -1])


def judge(docs: DataFrame, forest: Forest, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's counts, ``base_failed``, ``score`` and ``kept``, without a shuffle.

    Defined cases: a null or empty text has no words and fails the base rules;
    ids may be null or repeat, each row is judged on its own; other columns are
    ignored; an empty table gives an empty result.
    """
    shared = shipped(docs.sparkSession).sparkContext.broadcast(forest)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shown = COUNTS[:5]
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *[T.StructField(c, T.LongType()) for c in shown], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts in batches_with_counts(batches, 1):
            columns = [pa.array(counts[:, i].astype(np.int64)) for i in range(len(shown))]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(shared.value.score(features(counts)))], schema.names)

    judged = source.mapInArrow(tidy(run), schema)
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5))


def op5_boosted_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's word counts, base rules and the trees' verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
