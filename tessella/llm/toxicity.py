"""Toxicity by a chain of linear classifiers, one for each category.

The categories stand in a fixed order.  The model of a category sees which of
the chosen words and word beginnings a text has, which of them make up much of
it, and the probabilities of all earlier categories.  While training, those come
from models that didn't see the row (out-of-fold), so that later models learn
how far to trust them; while scoring, they come from the earlier models in turn.

Categories are columns of the labels where these have them.  Where they have a
single label, the toxic rows that are learnt from are put into kinds by the
words that go together in them, and each kind is a category.  Seed words can be
given instead; a link then doesn't see its own seed words, so it learns a
category from what stands beside them.

Each link's penalty is the one with the least log loss in left-out folds.  The
earlier links' probabilities are hardly penalised, so that what a link knows of
many weak words reaches the later ones whole.

Words and beginnings are 64-bit hashes; those to learn from are chosen by how
unevenly they fall on the labels, counted by partial aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import discard, shipped, smallest, staged, table, tidy
from .textspans import ALNUM, LOWER, buffers, groups, mixed, spans, word_hashes

#: Documented bound: labelled rows that are learnt from, for each label (those with the smallest hashes of their ids); and rows of documents with these ids that differ in what the models see (copies count as often as they stand, the smallest hashes go first).
MOST_ROWS = 4_000
#: Words and beginnings that the models see at most, the standard errors by which their shares among the labels differ at least, the characters of beginnings, and how many words of a text there is one of them for at least where it makes up much of the text.
CHOSEN, UNEVEN, BEGINNINGS, MUCH = 384, 3.5, (3, 5, 7), (200, 100, 50)
#: Folds, the penalties that a link's is chosen of (the strongest first), and the penalty of earlier links' probabilities and of the constant.
FOLDS, PENALTIES, SLIGHT = 5, (1.0, 0.3, 0.1, 0.03, 0.01), 1e-3
#: The kinds of toxic rows where labels have no columns of categories, and the rows that may be the first of a kind (those that come first).
KINDS, FIRSTS = 4, 512
#: The last category, the label itself.
LAST = "toxic"
_OF_BEGINNING, _OF_MUCH = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _code_points(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _beginning(hashes: np.ndarray, length: int) -> np.ndarray:
    return mixed(hashes ^ _OF_BEGINNING ^ np.uint64(length))


def _much(hashes: np.ndarray, words: int) -> np.ndarray:
    return mixed(hashes ^ _OF_MUCH ^ np.uint64(words))


def text_features(column: pa.Array) -> list[np.ndarray]:
    """The distinct hashes of each text's words and of the beginnings of longer ones; once more, each with other hashes, of those that make up much of the text."""
    out: list[np.ndarray] = []
    data, offsets = buffers(pc.utf8_lower(column.fill_null("")))
    for a, b in groups(offsets):
        own = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, counts = spans(own, offsets[a : b + 1] - offsets[a], ALNUM)
        if not len(starts):
            out += [np.zeros(0, np.uint64)] * (b - a)
            continue
        heads = np.flatnonzero(_code_points(own))
        doc = np.repeat(np.arange(b - a), counts)
        at = np.searchsorted(heads, starts)
        found, of = [word_hashes(own, starts, ends)], [doc]
        for length in BEGINNINGS:
            after = at + length
            cut = np.where(after < len(heads), heads[np.minimum(after, len(heads) - 1)], len(own))
            longer = cut < ends
            found.append(_beginning(word_hashes(own, starts[longer], cut[longer]), length))
            of.append(doc[longer])
        hashes, of = np.concatenate(found), np.concatenate(of)
        order = np.lexsort((hashes, of))
        hashes, of = hashes[order], of[order]
        new = np.ones(len(of), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        first = np.flatnonzero(new)
        times, hashes, of = np.diff(np.append(first, len(of))), hashes[first], of[first]
        much = [times * words >= counts[of] for words in MUCH]
        hashes = np.concatenate([hashes, *[_much(hashes[m], words) for m, words in zip(much, MUCH, strict=True)]])
        of = np.concatenate([of, *[of[m] for m in much]])
        order = np.argsort(of, kind="stable")
        out += np.split(hashes[order], np.searchsorted(of[order], np.arange(1, b - a)))
    return out


def _word(w: str) -> int:
    """The hash of a whole word, as a signed number."""
    data = np.frombuffer(w.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)])).view(np.int64)[0])


@dataclass(frozen=True)
class Chain:
    """``chosen``: sorted hashes; ``weights``: of each category, for the chosen, the earlier categories and a constant."""

    categories: tuple[str, ...]
    chosen: np.ndarray
    weights: tuple[np.ndarray, ...]

    def seen(self, features: list[np.ndarray]) -> np.ndarray:
        """Which of the chosen each text has."""
        x = np.zeros((len(features), len(self.chosen)), np.float64)
        if len(self.chosen):
            for i, f in enumerate(features):
                place = np.minimum(np.searchsorted(self.chosen, f), len(self.chosen) - 1)
                x[i, place[self.chosen[place] == f]] = 1
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column for each category, in the order of the chain."""
        out = np.zeros((len(x), 0))
        for w in self.weights:
            p = _logistic(np.concatenate([x, out, np.ones((len(x), 1))], axis=1) @ w)
            out = np.concatenate([out, p[:, None]], axis=1)
        return out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _linear(x: np.ndarray, y: np.ndarray, times: np.ndarray, penalty: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Penalised logistic regression by Newton's method, each row counted so many times, with the penalty of each weight."""
    w = np.zeros(x.shape[1]) if start is None else start
    for _ in range(25):
        p = _logistic(x @ w)
        curve = (x.T * (times * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(penalty)
        step = np.linalg.solve(curve, x.T @ (times * (y - p)) - penalty * w)
        w = w + step
        if np.abs(step).max(initial=0) < 1e-3:
            break
    return w


def _link(x: np.ndarray, y: np.ndarray, fold: np.ndarray, times: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """A link's weights and its out-of-fold probabilities, with the penalty whose log loss in the folds left out is least; of equal ones the strongest.

    The first ``words`` columns are penalised, the others slightly.
    """
    best: tuple = (np.inf,)
    total = max(times.sum(), 1)
    fitted, of_fold = None, [None] * FOLDS
    for strength in PENALTIES:
        penalty = np.full(x.shape[1], SLIGHT)
        penalty[:words] = strength
        fitted = _linear(x, y, times, penalty, fitted)  # from the stronger penalty's weights, which are near
        left_out = np.full(len(x), np.average(y, weights=times) if len(x) else 0.0)
        for f in range(FOLDS):
            out = fold == f
            if out.any() and not out.all():
                of_fold[f] = _linear(x[~out], y[~out], times[~out], penalty, of_fold[f])
                left_out[out] = _logistic(x[out] @ of_fold[f])
        sure = np.clip(left_out, 1e-9, 1 - 1e-9)
        loss = -(times * (y * np.log(sure) + (1 - y) * np.log(1 - sure))).sum() / total
        if loss < best[0] - 1e-9:
            best = (loss, fitted, left_out)
    return best[1], best[2]


def train(x: np.ndarray, y: np.ndarray, fold: np.ndarray, chosen: np.ndarray, categories: tuple[str, ...], times: np.ndarray | None = None, hidden: dict[int, list[int]] | None = None, linked: bool = True) -> Chain:
    """Fit the chain.

    ``y`` has a column for each category, ``fold`` the part that each row is held
    out with, ``times`` how often each row stands (once if none are given),
    ``hidden`` the columns of ``x`` that a link doesn't see (their weights are
    0).  Without ``linked`` no link sees the earlier ones, to tell what these add.
    """
    times = np.ones(len(x)) if times is None else times
    one, earlier, weights = np.ones((len(x), 1)), np.zeros((len(x), 0)), []
    for k in range(y.shape[1]):
        own = x.copy()
        own[:, (hidden or {}).get(k, [])] = 0
        seen = np.concatenate([own, earlier if linked else 0 * earlier, one], axis=1)
        fitted, left_out = _link(seen, y[:, k], fold, times, x.shape[1])
        weights.append(fitted)
        earlier = np.concatenate([earlier, left_out[:, None]], axis=1)
    return Chain(categories, chosen, tuple(weights))


def kinds(x: np.ndarray, toxic: np.ndarray, times: np.ndarray, number: int = KINDS) -> np.ndarray:
    """Which of ``number`` kinds each toxic row is of, as a column for each kind; rows that aren't toxic, or have no word that toxic rows have more often, are of none.

    Spherical k-means on the words that toxic rows have more often, weighted by
    how unevenly they fall.  The first row of a kind is the one that brings the
    rows nearest to the kinds found so far; of equal ones, the one that comes first.
    """
    out = np.zeros((len(x), number))
    n1, n0 = (times * toxic).sum(), (times * (1 - toxic)).sum()
    if not x.shape[1] or not n1:
        return out
    with1, with0 = (times * toxic) @ x, (times * (1 - toxic)) @ x
    error = np.sqrt(np.maximum((with1 + with0) / (n1 + n0), 1e-12) * (1 / n1 + 1 / max(n0, 1)))
    rows = np.flatnonzero(toxic == 1)
    u = x[rows] * np.maximum((with1 / n1 - with0 / max(n0, 1)) / error, 0)
    length = np.linalg.norm(u, axis=1)
    rows, u, many = rows[length > 0], u[length > 0] / length[length > 0, None], times[rows[length > 0], None]
    if not len(rows):
        return out
    firsts = u @ u[:FIRSTS].T
    near, middles = np.zeros((len(u), 1)), np.zeros((0, x.shape[1]))
    for _ in range(number):
        best = int((many * np.maximum(firsts - near, 0)).sum(axis=0).argmax())
        middles = np.concatenate([middles, u[best : best + 1]])
        near = np.maximum(near, firsts[:, best : best + 1])
    for _ in range(30):
        of = (u @ middles.T).argmax(axis=1)
        moved = np.stack([(many * u)[of == j].sum(axis=0) if (of == j).any() else middles[j] for j in range(number)])
        moved /= np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.allclose(moved, middles):
            break
        middles = moved
    out[rows, of] = 1
    return out


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", category_cols: tuple[str, ...] = (), categories: dict[str, tuple[str, ...]] | None = None, most_rows: int = MOST_ROWS, linked: bool = True) -> Chain:
    """Choose words and fit the chain on at most ``most_rows`` labelled rows of each label that aren't held out.

    ``category_cols`` are columns of ``labels`` (0 or 1, null counts as 0) for
    the categories before the last, in the order of the chain.  If there are none,
    ``categories`` may have seed words, which mark a row labelled toxic as one of
    them; without either, they are the kinds that the toxic rows fall into.
    """
    spark = shipped(docs.sparkSession)
    marks = {} if category_cols else {c: [_word(w) for w in words] for c, words in (categories or {}).items()}
    names = (*(category_cols or marks or [f"kind_{i + 1}" for i in range(KINDS)]), LAST)
    targets = [f"t{i}" for i in range(len(category_cols))]
    known = labels.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{label_col}`").cast("long").alias("label"),
        *[F.when(F.col(f"`{c}`").cast("long") == 1, 1).otherwise(0).cast("long").alias(t) for c, t in zip(category_cols, targets, strict=True)],
    ).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    some = [smallest(known.where(F.col("label") == k), F.xxhash64("id"), most_rows, "id", *targets) for k in (0, 1)]
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    numbers = ["fold", "label", *targets]
    marked = texts.join(F.broadcast(some[0].unionByName(some[1])), "id").withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS))).select(*numbers, "text")  # broadcast: at most 2 * most_rows rows of a few numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.view(np.int64) for f in text_features(batch.column(len(numbers)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(numbers)], pa.array(found, pa.list_(pa.int64()))], [*numbers, "hashes"])

    rows = staged(marked.mapInArrow(tidy(run), ", ".join(f"{n} long" for n in numbers) + ", hashes array<bigint>"), "toxicity")
    sides = ["label", *targets]
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sides]).first()
    counted = rows.select(*sides, F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sides])
    counted = staged(counted.where(F.col("n") >= 3), "toxicity")
    wanted = {h for own in marks.values() for h in own}
    for c in sides:
        n1, n0 = max(totals[c], 1), max(totals["n"] - totals[c], 1)
        error = F.sqrt(F.col("n") / F.lit(max(totals["n"], 1)) * (1 / n0 + 1 / n1))
        uneven = F.abs(F.col(c) / n1 - (F.col("n") - F.col(c)) / n0) / error
        wanted |= {r["hash"] for r in counted.where(uneven >= UNEVEN).orderBy(uneven.desc(), "hash").limit(CHOSEN // len(sides)).collect()}
    some_hashes = rows.select(*numbers, F.array_intersect("hashes", F.array(*[F.lit(h) for h in sorted(wanted)]).cast("array<bigint>")).alias("hashes"))
    shorter = staged(some_hashes.groupBy(*numbers, "hashes").agg(F.count("*").alias("times")), "toxicity")
    # ids repeat in documents: a bound over both labels would cut one of them first
    alike = shorter.withColumn("_text", F.to_json("hashes"))
    data = [r for k in (0, 1) for r in smallest(alike.where(F.col("label") == k), F.xxhash64(*numbers, "hashes"), most_rows, *numbers, "_text").collect()]
    discard(rows, counted, shorter)
    chosen = np.sort(np.array(sorted(wanted), np.int64).view(np.uint64))
    x = Chain(names, chosen, ()).seen([np.array(r["hashes"], np.int64).view(np.uint64) for r in data])
    toxic = np.array([r["label"] for r in data], float)
    at = {int(h): i for i, h in enumerate(chosen.view(np.int64))}
    hidden = {k: [at[h] for h in own] for k, own in enumerate(marks.values())}
    times = np.array([r["times"] for r in data], float)
    y = [toxic * (x[:, own].max(axis=1) if len(x) else 0) for own in hidden.values()] + [np.array([r[t] for r in data], float) for t in targets]
    if not y:
        y = list(kinds(x, toxic, times).T)
    y = np.stack([*y, toxic], axis=1).reshape(len(x), len(names))
    return train(x, y, np.array([r["fold"] for r in data], int), chosen, names, times, hidden, linked)


def score(docs: DataFrame, chain: Chain, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The probability of each category for every whole text, without a shuffle.

    Defined cases: a null or empty text has no words, so each category has the
    probability of its constant; ids may be null or repeat, each row is scored
    on its own; other columns are ignored; an empty table gives an empty result.
    If the labels name one class only, all rows score alike.
    """
    shared = shipped(docs.sparkSession).sparkContext.broadcast(chain)
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField(id_col, source.schema["id"].dataType), *[T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                p = shared.value.probabilities(shared.value.seen(text_features(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, np.ascontiguousarray(p.T))], schema.names)

    return source.mapInArrow(tidy(run), schema)


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of each category, and whether it is toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    p = F.col(f"p_{LAST}")
    return scored.withColumns({"score": p, "predicted": (p >= 0.5).cast("int"), "toxic": p >= 0.5})
