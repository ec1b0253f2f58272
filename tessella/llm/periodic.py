"""Periodic runs: stretches of words that repeat with a period, by the divide and conquer of Main and Lorentz.

A text's words are interned as numbers.  Segments of 2^j words are halved at
their midpoints; each run crosses the midpoint of exactly one segment that holds
it whole.  With four periods or more it has two of them on one side of the
midpoint, so there the Z-value of the midpoint at distance q (how far the words
from the midpoint equal those q further on, or, read backwards, those before) is
q at least.  The Z-values of all midpoints of a level, and of all texts of a
batch, are worked out together: a position leaves as soon as a word differs.
What is left is extended to both sides, within its segment; what goes beyond it
belongs to a segment above.

Python keeps the words of a group of texts at a time; a text's own work is
n log n at most, however it repeats itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import shipped, table, tidy

#: A run has so many words at least, and so many periods.
LEAST_WORDS, PERIODS = 6, 4
#: Words of the texts that are searched together, about, and words compared for all positions at once before each is looked at alone.
GROUP_WORDS, TOGETHER = 1 << 19, 24
#: What separates words.
SPACES = r"[ \t\n\x0B\f\r]+"

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)
_ARROW_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def _forward(s: np.ndarray, at: int, q: int, stop: int) -> int:
    """The first place from ``at`` whose word differs from the one q before, or ``stop``."""
    step = 32
    while at < stop:
        to = min(at + step, stop)
        differs = s[at:to] != s[at - q : to - q]
        k = int(differs.argmax())
        if differs[k]:
            return at + k
        at, step = to, step * 4
    return stop


def _backward(s: np.ndarray, at: int, q: int, stop: int) -> int:
    """The smallest place such that each word from it to before ``at`` equals the one q after; ``stop`` at least."""
    step = 32
    while at > stop:
        to = max(at - step, stop)
        differs = (s[to:at] != s[to + q : at + q])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return at - k
        at, step = to, step * 4
    return stop


def _z_values(s: np.ndarray, at: np.ndarray, q: np.ndarray, way: int) -> np.ndarray:
    """Which midpoints' Z-values at distance q (``way`` 1: onwards, -1: backwards) are q or ``TOGETHER`` at least; the first word is known to be equal."""
    done, left = [], np.arange(len(q))
    for t in range(1, TOGETHER):
        over = q[left] <= t
        if over.any():
            done.append(left[over])
            left = left[~over]
        if not len(left):
            break
        here = at[left] + way * t
        left = left[s[here] == s[here + way * q[left]]]
    return np.sort(np.concatenate([*done, left]))


def _level(s: np.ndarray, begins: np.ndarray, ends: np.ndarray, half: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs (text, start, end, period) that cross the midpoint of a segment of ``2 * half`` words and lie in it."""
    many = np.maximum(0, -(-(ends - begins - half) // (2 * half)))
    text = np.repeat(np.arange(len(begins)), many)
    if not len(text):
        return
    within = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    mids = begins[text] + half + 2 * half * within
    lows, highs = mids - half, np.minimum(mids + half, ends[text])
    longest = half // 2
    padded = np.concatenate([s, np.full(longest + 1, -1, s.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, longest)
    node, d = np.nonzero(windows[mids + 1] == s[mids][:, None])
    fits = mids[node] + 2 * (d + 1) <= highs[node]
    node, d = node[fits], d[fits] + 1
    right = _z_values(s, mids[node], d, 1)
    found = [np.stack([node[right], d[right], np.ones(len(right), np.int64)])]
    node, d = np.nonzero(windows[mids - 1 - longest] == s[mids - 1][:, None])
    d = longest - d
    left = _z_values(s, mids[node] - 1, d, -1)
    found.append(np.stack([node[left], d[left], np.zeros(len(left), np.int64)]))
    nodes, periods, sides = np.concatenate(found, axis=1)
    order = np.lexsort((sides, periods, nodes))
    last, low_known, high_known, seen = -1, 0, 0, set()
    for k, q, onwards in zip(nodes[order].tolist(), periods[order].tolist(), sides[order].tolist(), strict=True):
        m = int(mids[k])
        if k != last:
            last, low_known, high_known, seen = k, m, m, set()
        # two periods inside a run of a smaller period: the same run, or one that is not its smallest period
        if (onwards and m + 2 * q <= high_known) or (not onwards and m - 2 * q >= low_known):
            continue
        if q > TOGETHER and not np.array_equal(s[m : m + q] if onwards else s[m - q : m], s[m + q : m + 2 * q] if onwards else s[m - 2 * q : m - q]):
            continue
        i, low, high = int(text[k]), int(lows[k]), int(highs[k])
        start = _backward(s, m if onwards else m - q, q, low)
        end = _forward(s, m + q if onwards else m, q, high)
        low_known, high_known = min(low_known, start), max(high_known, end)
        wider = (start == low and low > begins[i] and s[low - 1] == s[low - 1 + q]) or (end == high and high < ends[i] and s[high] == s[high - q])
        if wider or not start < m < end or end - start < max(LEAST_WORDS, PERIODS * q) or (start, end) in seen:  # what only touches the midpoint lies in a smaller segment
            continue
        seen.add((start, end))
        yield i, start - int(begins[i]), end - start, q


def runs(s: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Every run (start, length, smallest period) of each text, by start and period; ``s`` has the texts' words as numbers, one after another."""
    ends = np.cumsum(counts)
    begins = ends - counts
    found: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    half = 4  # segments of eight words are the smallest that hold a run
    while half < max(counts.tolist(), default=0):
        for i, *run in _level(s, begins, ends, half):
            found[i].append(tuple(run))
        half *= 2
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def _kept(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words but for those after a run's first period."""
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    stay = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, keep in zip(words, stay.tolist(), strict=True) if keep])


def find_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, ``n_words``, ``runs`` (start, length, period, by start and period) and ``collapsed``, the text without the repetitions.

    Words are parted by ASCII white space.  A null text counts as empty: no
    words, no runs, an empty ``collapsed``.  Each row stands for itself, whether
    its id is null or repeats; other columns are left behind, whatever their
    names.  An empty table gives an empty one.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    shipped(docs.sparkSession)

    def groups(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
        at, group, size = 0, [], 0
        for i, t in enumerate(texts.cast(pa.binary())):
            group.append((t.as_py() or b"").split())
            size += len(group[-1])
            if size >= GROUP_WORDS or i + 1 == len(texts):
                yield at, group
                at, group, size = i + 1, [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in groups(batch.column(1)):
                number: dict[bytes, int] = defaultdict(count().__next__)
                counts = np.array([len(g) for g in group], np.int64)
                s = np.fromiter((number[w] for g in group for w in g), np.int32, int(counts.sum()))
                found = runs(s, counts)
                columns = [
                    batch.column(0).slice(at, len(group)),
                    pa.array(counts),
                    pa.array([[{"start": a, "length": b, "period": c} for a, b, c in x] for x in found], _ARROW_RUNS),
                    pa.array([_kept(g, x) for g, x in zip(group, found, strict=True)], pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    kinds = [source.schema["id"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())]
    return source.mapInArrow(tidy(run), T.StructType(kinds)).withColumnRenamed("id", id_col)


def planted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts of a tenth of all ids, chosen by hash, with a period put into them from some word on; the others, and null ids, as they are."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    g = F.floor(h / F.lit(10))
    # arrays are cut and repeated whole, as a lambda would split the text again for each word
    words = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), g.alias("g"), F.when(h % 10 == 0, F.array_remove(F.split("text", SPACES), "")).alias("words"))
    sized = words.withColumn("n", F.coalesce(F.size("words"), F.lit(-1)))
    begin = F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int"))
    period = (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    cut = sized.withColumn("a", begin).withColumn("p", period)
    again = F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))
    new = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), F.flatten(again)), F.lit(1), F.col("n")), " ")
    return cut.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias(text_col))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's runs, the most repeated of them, and digests of all runs and of the text without repetitions; periods are planted first."""
    rows = find_runs(planted(table(spark, sf_dir, "documents")))
    # the greatest length / period, as fractions; the first in order stays
    best = F.aggregate(
        F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))),
        F.get("runs", F.lit(0)),
        lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a),
    )
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), F.concat(x["period"].cast("string"), F.lit("\n")))), "")
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
