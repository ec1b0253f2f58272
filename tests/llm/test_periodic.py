"""Runs of words against a search of all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import periodic


def brute_runs(words):
    """Every maximal stretch of each period; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_planted(doc_id, text):
    words = (text or "").encode().split()
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_row(doc_id, text):
    words = brute_planted(doc_id, text)
    found = brute_runs(words)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for a, n, q in found for i in range(a + q, a + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()), sha(kept))


def searched(*texts):
    numbers = {}
    counts = np.array([len(t) for t in texts], np.int64)
    s = np.array([numbers.setdefault(w, len(numbers)) for t in texts for w in t], np.int32)
    return periodic.runs(s, counts)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=5))
def test_runs_of_few_words_equal_brute_force(texts):
    assert searched(*texts) == [brute_runs(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 12), st.lists(st.integers(0, 3), max_size=6)), max_size=8))
def test_planted_runs_equal_brute_force(parts):
    text = [w for block, times, noise in parts for w in block * times + noise]
    assert searched(text) == [brute_runs(text)]


def test_long_periods_and_powers():
    rng = random.Random(1)
    block = [rng.randrange(5) for _ in range(180)]
    texts = [block * 5, block * 9 + block[:77], [0] * 3_000, [0, 1] * 1_500 + [2] + [0, 1, 0] * 700, [0, 0, 1] * 40 + [0, 0, 1, 0, 0, 1, 1] * 90, list(range(50)) * 40]
    assert searched(*texts) == [brute_runs(t) for t in texts]


def test_time_of_one_word_repeated_is_near_linear():
    import time

    began = time.perf_counter()
    assert searched([0] * 300_000) == [[(0, 300_000, 1)]]
    assert time.perf_counter() - began < 30


def test_operator_on_odd_rows(spark):
    rows = [(1, "a b " * 3, "x"), (1, "a b " * 3, "x"), (None, "a " * 8, "y"), (2, None, "z"), (3, "", "z"), (4, " \t\n ", None), (5, "ü v\x1c " * 7, None), (6, "x " * 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    found = sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.find_runs(docs).collect())
    assert found == [(0, 8, [(0, 8, 1)], "a"), (1, 6, [], "a b a b a b"), (1, 6, [], "a b a b a b"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""), (5, 7, [(0, 7, 1)], "ü v\x1c"), (6, 5, [], "x x x x x")]
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    wanted = sorted(brute_row(d["doc_id"], d["text"]) for d in docs)
    found = periodic.op12_periodic_runs(spark, sf_dir)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect())) == wanted
    assert sum(r[1] for r in wanted) > 10


@pytest.mark.parametrize("text", ["w" + " w" * 200_000, " ".join(str(i % 50_000) for i in range(400_000))])
def test_very_long_texts(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = periodic.find_runs(docs).select("n_words", "runs").collect()
    assert len(row["runs"]) == 1 and row["runs"][0]["length"] == row["n_words"]
