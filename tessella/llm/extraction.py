"""HTML extraction with a tree-structured graphical model over DOM nodes.

Every node of a page is content or not.  Its own evidence is a logistic model of
its features; a potential for each pair of parent and child, by the kind of the
child, says how labels go together.  As the graph is a tree, one pass of sum-
product messages up and one down give the exact marginals.  All pages of a batch
are worked on level by level at once.  Both parts are learnt from labelled pages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dom import GROUPS, Page, Trees, parse, trees
from .labelled_pages import labelled_pages
from .support import shipped, table, tidy

#: Characters of html that are parsed before their pages are scored.
TOGETHER = 1 << 21


@dataclass(frozen=True)
class TreeModel:
    """``weights`` of a node's own evidence for content; ``potentials`` [kind of the child, parent's label, child's label], as logarithms."""

    weights: np.ndarray
    potentials: np.ndarray

    def beliefs(self, t: Trees) -> tuple[np.ndarray, np.ndarray]:
        """Each node's log-belief in both labels, and the logarithms of each child's joint belief with its parent."""
        n = len(t.parent)
        inside, upward, pair = np.zeros((n, 2)), np.zeros((n, 2)), self.potentials[t.kind]
        inside[:, 1] = t.features @ self.weights
        for nodes in t.levels[::-1]:
            upward[nodes] = np.logaddexp(pair[nodes, :, 0] + inside[nodes, :1], pair[nodes, :, 1] + inside[nodes, 1:])
            np.add.at(inside, t.parent[nodes], upward[nodes])
        belief, joint = inside, np.zeros((n, 2, 2))
        for nodes in t.levels:
            rest = belief[t.parent[nodes]] - upward[nodes]  # what the parent knows from all but this child
            joint[nodes] = pair[nodes] + rest[:, :, None] + belief[nodes][:, None, :]
            belief[nodes] += np.logaddexp(pair[nodes, 0, :] + rest[:, :1], pair[nodes, 1, :] + rest[:, 1:])
            shift = belief[nodes].max(axis=1, keepdims=True)
            belief[nodes] -= shift
        return belief, joint

    def marginals(self, t: Trees) -> np.ndarray:
        """The probability that each node is content, given the whole tree."""
        belief, _ = self.beliefs(t)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def fit(pages: list[tuple[str, list[int]]], ridge: float = 0.5, rounds: int = 60) -> TreeModel:
    """Learn from (html, label of each node in the parser's order, the root first).

    The weights start from logistic regression on single nodes.  Then weights
    and potentials climb the penalised likelihood of whole trees together; its
    gradient is what was seen less what the messages expect.
    """
    t, y = trees([parse(h) for h, _ in pages]), np.concatenate([np.array(labels, float) for _, labels in pages])
    weights = np.zeros(t.features.shape[1])
    for _ in range(25):  # Newton's method on the penalised logistic loss
        p = 1 / (1 + np.exp(-np.clip(t.features @ weights, -30, 30)))
        curve = (t.features.T * np.maximum(p * (1 - p), 1e-6)) @ t.features + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, t.features.T @ (y - p) - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    child = np.flatnonzero(t.parent >= 0)
    seen = np.zeros((len(GROUPS) + 1, 2, 2))
    np.add.at(seen, (t.kind[child], y[t.parent[child]].astype(int), y[child].astype(int)), 1)
    flat = np.concatenate([weights, np.zeros(seen.size)])
    mean, square = np.zeros(len(flat)), np.zeros(len(flat))
    for k in range(1, rounds + 1):
        model = TreeModel(flat[: len(weights)], flat[len(weights) :].reshape(seen.shape))
        p, (_, joint) = model.marginals(t), model.beliefs(t)
        joint = np.exp(joint[child] - joint[child].max(axis=(1, 2), keepdims=True))
        expected = np.zeros(seen.shape)
        np.add.at(expected, t.kind[child], joint / joint.sum(axis=(1, 2), keepdims=True))
        slope = np.concatenate([t.features.T @ (y - p), (seen - expected).ravel()]) - ridge * flat
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        flat = flat + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return TreeModel(flat[: len(weights)], flat[len(weights) :].reshape(seen.shape))


def main_text(page: Page, content: np.ndarray) -> str:
    """The text of the content nodes: white space inside a block is one space, blocks are joined by a line feed."""
    blocks: list[str] = []
    last, held = None, []
    for node, block, text in page.runs:
        if block != last:
            blocks.append("".join(held))
            last, held = block, []
        if content[node] >= 0.5:
            held.append(text)
    blocks.append("".join(held))
    return "\n".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def extract_many(sources: list[str], model: TreeModel) -> list[str]:
    """The main text of each page."""
    parsed = [parse(s) for s in sources]
    t = trees(parsed)
    content = model.marginals(t)
    return [main_text(p, content[f : f + len(p.tag)]) for p, f in zip(parsed, t.first, strict=True)]


def extract(pages: DataFrame, model: TreeModel | None = None, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` to the columns ``keep`` (all but the html by default), without a shuffle.

    Defined cases: null or empty html gives an empty text; cut-off, unclosed or
    crossed markup is read as far as it goes, however deep elements are nested;
    an embedded element (video, svg, select and the like) that is never closed is
    empty; an unclosed script, style, textarea, title or frame lasts to the end,
    as in browsers; pages may repeat; a column named ``text`` among those kept
    gives way to the extracted text; an empty table gives an empty result.
    """
    spark = shipped(pages.sparkSession)
    shared = spark.sparkContext.broadcast(model or fit(labelled_pages()))
    kept = [c for c in keep or pages.columns if c not in (html_col, "text")]
    source = pages.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{html_col}`").alias("html"))
    schema = T.StructType([source.schema["row"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, waiting, size = 0, [], 0
            for i, value in enumerate(batch.column(1)):
                waiting.append(value.as_py() or "")
                size += len(waiting[-1])
                if size >= TOGETHER or i == batch.num_rows - 1:
                    texts = pa.array(extract_many(waiting, shared.value), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(waiting)), texts], schema.names)
                    at, waiting, size = i + 1, [], 0

    return source.mapInArrow(tidy(run), schema).select(*[F.col(f"row.`{c}`") for c in kept], "text")


def op9_dom_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).withColumn("n_chars", F.char_length("text").cast("long"))
