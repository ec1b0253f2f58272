"""Occurrences of benchmark windows against brute force."""

import random
import re

import duckdb
import pytest

from tessella.llm import decontamination as d
from tessella.llm import queries

from ..conftest import rows_of
from .fixtures import clashing, documents, prose, table_of

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(rows, items, window=10):
    out = []
    for r in rows:
        w, hit, found = words(r[1]), set(), set()
        for item, text in items:
            v = words(text)
            n = min(window, len(v))
            for p in range(len(v) - n + 1 if v else 0):
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == v[p : p + n]:
                        hit.update(range(q, q + n))
                        found.add(str(item))
        out.append(repr((r[0], len(w), sorted(hit), sorted(found))))
    return sorted(out)


def case(seed):
    r = random.Random(seed)
    rows = documents(seed, 30)
    rows = [x for x in rows if len(x[1] or "") < 20_000]
    items = [(i, prose(r, r.randint(11, 30))) for i in range(6)]
    items += [(6, "omega psi"), (7, ""), (8, None), (9, "日本 ñandú"), (10, items[0][1]), (0, prose(r, 12)), (None, prose(r, 12)), (11, " ".join(["nu"] * 14))]
    for i, (_, text) in enumerate(items):
        cut = (text or "").split()
        rows.append((500 + i, prose(r, 5) + " " + " ".join(cut[r.randint(0, 1) :]).upper() + "!! " + prose(r, 4), "en", "s", 1))
    rows += [(600, "nu " * 40, "en", "s", 1), (601, items[1][1].replace(" ", "\n-- "), "en", "s", 1)]
    return rows, items


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_equals_brute_force(spark, seed, block_bytes):
    rows, items = case(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = d.find_leaks(clashing(table_of(spark, rows)), clashing(bench), block_bytes=block_bytes).collect()
    assert sorted(repr((r["row"]["doc_id"], r["n_words"], r["covered"], r["items"])) for r in got) == brute(rows, items)


def test_matches_are_the_longest(spark):
    rows, items = case(4)
    texts = {}
    for i, t in items:
        texts.setdefault(str(i), []).append(words(t))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for r in d.find_leaks(table_of(spark, rows), bench).collect():
        w = words(r["row"]["text"])
        for m in r["matches"]:
            assert any(w[m["doc_word"] : m["doc_word"] + m["words"]] == v[m["item_word"] : m["item_word"] + m["words"]] for v in texts[m["item_id"]])
        longest = {(m["item_id"], m["doc_word"] + k) for m in r["matches"] for k in range(m["words"])}
        assert {p for _, p in longest} == set(r["covered"])


def test_clean_documents_come_as_they_were(spark):
    rows, items = case(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table_of(spark, rows)
    clean = d.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    hit = {eval(x)[0] for x in brute(rows, items) if eval(x)[2]}
    assert {r["doc_id"] for r in clean.collect()} - {None} == {r[0] for r in rows if r[0] not in hit} - {None}


def test_empty_sides(spark):
    rows, items = case(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert d.find_leaks(table_of(spark, rows).limit(0), bench).count() == 0
    assert d.find_leaks(table_of(spark, rows), bench.limit(0)).where("size(covered) > 0").count() == 0




def test_repeated_texts_don_t_fill_one_block(spark):
    text = " ".join(prose(random.Random(3), 30).split())
    items = [(i, text) for i in range(40)]
    rows = [(1, text + " and more", "en", "s", 1), (2, text + " x " + text, "en", "s", 1), (3, "clean", "en", "s", 1)]
    bench = spark.createDataFrame(items + items[:5], "item_id long, text string")
    got = {r["row"]["doc_id"]: r for r in d.find_leaks(table_of(spark, rows), bench, block_bytes=4 * len(text), matches=False).collect()}
    assert sorted(map(int, got[1]["items"])) == sorted(map(int, got[2]["items"])) == list(range(40)) and not got[3]["items"]
    assert not any(r["matches"] for r in got.values())


def test_sql_agrees(spark, tmp_path):
    rows, items = case(7)
    table_of(spark, [r for r in rows if r[0] is not None]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.QUERIES["op7_suffix_decontamination"](spark, str(tmp_path)).toPandas()
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    assert rows_of(got) == rows_of(db.execute(queries.ORACLES["op7_suffix_decontamination"]).df())


def brute_longest(text, items):
    """The longest common stretch of words with any item, if it holds a window of it."""
    words = [w for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())]
    best = None
    for item, body in items:
        theirs = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (body or "").encode().lower())
        least = min(10, len(theirs))
        for p in range(len(words)):
            for q in range(len(theirs)):
                k = 0
                while p + k < len(words) and q + k < len(theirs) and words[p + k] == theirs[q + k]:
                    k += 1
                if least and k >= least:
                    found = (-k, p, str(item))
                    best = min(best, found) if best else found
    return best and (-best[0], best[1], best[2])


@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_longest_matches_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(d, "EXTENDED", 7)
    rng = random.Random(block_bytes)
    word = lambda: rng.choice("ab cd ef gh ij".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 12, 25])))) for i in range(8)]
    texts = []
    for i in range(40):
        parts = [word() for _ in range(rng.randrange(25))]
        for _ in range(rng.randrange(3)):
            own = rng.choice(items)[1].split()
            at = rng.randrange(len(own) + 1)
            parts[rng.randrange(len(parts) + 1) : 0] = own[at:]
        texts.append((i, " ".join(parts)))
    docs, bench = spark.createDataFrame([*texts, (99, None)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {r["row"]["doc_id"]: r["longest"] and tuple(r["longest"]) for r in d.find_leaks(docs, bench, block_bytes=block_bytes, matches=False).collect()}
    want = {i: brute_longest(t, items) for i, t in [*texts, (99, None)]}
    assert found == want and sum(v is not None for v in want.values()) > 4
