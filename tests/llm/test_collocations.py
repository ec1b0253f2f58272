"""Phrases against counts made word by word."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.llm import collocations as C


def brute_counts(texts, depth=4):
    f, n = defaultdict(Counter), Counter()
    for lang, text in texts:
        lang, text = lang or "und", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, depth + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    return f, n


def brute(texts, least=30, top=2000):
    counts, n = brute_counts(texts)
    out = []
    for lang, f in counts.items():
        rows = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        for p, a in candidates.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-1, 3), max_size=60))
def test_automaton_has_every_phrase_once_with_its_places(words):
    found = C.automaton(np.array(words, np.int64), 4)
    spelt = lambda k, size: tuple(words[found.end[k] - size + 1 : found.end[k] + 1])
    places, of = {}, {}
    for k in range(len(found.end)):
        for size in range(found.shortest[k], found.longest[k] + 1):
            assert spelt(k, size) not in places
            places[spelt(k, size)], of[spelt(k, size)] = int(found.places[k]), k
    wanted = Counter(tuple(words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1) if -1 not in words[i : i + k])
    assert places == dict(wanted)
    for k in range(len(found.end)):
        link = spelt(k, found.shortest[k])[1:]
        assert found.link[k] == (of[link] if link else -1)


def made(seed, rows):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "New", "york", "city", "é", "\U0001f600", "\x1cz", "a b"] + [f"w{i}" for i in range(30)]
    phrases = ["new york city hall", "new york city", "of the", "in\tthe   end"]
    ends = [".", ",", ";", "\n", "\r", "\x0b", " ", " ", " ", " ", " "]
    text = lambda: "".join(rng.choice(phrases if rng.random() < 0.3 else vocabulary) + rng.choice(ends) for _ in range(rng.randrange(200)))
    return [(rng.choice(["en", "de", None]), text()) for _ in range(rows)] + [("en", None), (None, ""), ("xx", "one two")]


def test_collocations_equal_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed, 90)
        docs = spark.createDataFrame([(i, *r, "n") for i, r in enumerate(rows + rows[:10])], "doc_id long, lang string, text string, phrase string")
        for least in (30, 6):
            found = sorted(map(tuple, C.collocations(docs, least=least).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))
            assert found == brute(rows + rows[:10], least)
        assert len(found) > 100


def test_small_shards_and_a_full_bitmap_change_nothing(spark, monkeypatch):
    rows = made(3, 80)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    monkeypatch.setattr(C, "SHARD_WORDS", 300)
    monkeypatch.setattr(C, "_bitmap", lambda keys: spark.sparkContext.broadcast(np.full(1 << 24, 255, np.uint8)))
    assert sorted(map(tuple, C.collocations(docs, top=15).collect())) == brute(rows, top=15)


def test_bitmap_has_all_keys_and_few_others(spark):
    keys = spark.range(2000).select(F.xxhash64(F.lit("en"), F.concat(F.lit("w"), "id")).alias("key"))
    bits = C._bitmap(keys).value
    own = C._word_keys([f"w{i}".encode() for i in range(2000)], ["en"] * 2000)
    assert C._in(bits, own).all()
    assert int(np.unpackbits(bits).sum()) <= 2000
    assert not C._in(bits, C._word_keys([f"v{i}".encode() for i in range(2000)], ["en"] * 2000)).mean() > 0.01


def test_empty_and_rare(spark):
    docs = spark.createDataFrame([("en", "a b c"), (None, None)], "lang string, text string")
    assert C.collocations(docs).count() == 0 and C.collocations(docs.limit(0)).count() == 0


def test_one_very_long_text(spark):
    text = "over and out " * 200_000
    (row,) = C.collocations(spark.createDataFrame([("en", text)], "lang string, text string"), depth=2, top=1).collect()
    assert (row["phrase"], row["a"], row["n"]) == ("and out", 200_000, 600_000)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = C.op13_collocations(spark, sf_dir)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(docs)
