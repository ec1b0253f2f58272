"""Fingerprints, Golay keys and components against brute force."""

import numpy as np
import pytest
import xxhash

from tessella.llm import components, simhash

from .fixtures import clashing, documents, table_of


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    fps = [brute_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(repr((r[0], f"{fps[i]:016x}", least.get(find(i)))) for i, r in enumerate(rows))


def test_words_are_split_at_ascii_white_space_only():
    assert simhash.fingerprint("A b\u0085c d\x1ce".encode()) == brute_fingerprint("a b\u0085c D\x1ce".replace("D", "d"))


def test_golay_numbers_are_the_codewords_within_four():
    golay = simhash.Golay()
    rng = np.random.default_rng(1)
    words = np.array([m << 11 ^ simhash._remainder(m << 11) for m in range(4096)])
    assert all(simhash._remainder(int(w)) == 0 for w in words)
    for v in rng.integers(0, 1 << 23, 200):
        numbers, count = golay.numbers(np.array([v]))
        near = {int(w) >> 11 for w in words[np.bitwise_count(words ^ v) <= 4]}
        assert set(numbers[0].tolist()) == near and count[0] == len(near)


@pytest.mark.parametrize("errors", [0, 1, 2, 3, 4])
def test_pairs_within_four_bits_share_a_key(errors):
    rng = np.random.default_rng(errors)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for p in rng.choice(64, errors, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(p)
    sets = []
    for x in (a, b):
        keys, places = simhash.bucket_keys(x)
        own = [set() for _ in x]
        for k, p in zip(keys.tolist(), places.tolist(), strict=True):
            own[p].add(k)
        sets.append(own)
    assert all(x & y for x, y in zip(*sets, strict=True))


def test_groups_equal_brute_force(spark):
    rows = documents(5, 60)
    base = rows[0][1] + " " + rows[1][1] + " " + rows[2][1]
    words = base.split()
    rows += [(1000 + i, " ".join(words[:-i] if i else words), "en", "s", 1) for i in range(12)]
    got = simhash.near_duplicates(clashing(table_of(spark, rows)))
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute_groups(rows)
    assert simhash.near_duplicates(table_of(spark, rows).limit(0)).count() == 0


def test_chains_and_dense_groups_of_fingerprints(spark):
    """Chains of links, a ball of many near fingerprints, and bystanders."""
    rng = np.random.default_rng(9)
    flip = lambda x, n: x ^ sum(1 << int(p) for p in rng.choice(64, n, replace=False))
    fps = [int(x) for x in rng.integers(0, 1 << 63, 300)]
    chain = [fps[0]]
    for _ in range(40):
        chain.append(flip(chain[-1], 4))
    ball = [flip(fps[1], int(rng.integers(1, 4))) for _ in range(300)]
    every = np.unique(np.array(fps + chain + ball, np.uint64))
    got = {r["node"]: r["root"] for r in simhash.linked(spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")).collect()}
    root = list(range(len(every)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(every)):
        for j in np.flatnonzero(np.bitwise_count(every[:i] ^ every[i]) <= 4):
            root[find(i)] = find(int(j))
    mine, theirs = {}, {}
    for i, x in enumerate(every.view(np.int64).tolist()):
        mine.setdefault(got.get(x, x), set()).add(x)
        theirs.setdefault(find(i), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert len(got) == sum(len(g) for g in mine.values() if len(g) > 1)


def test_one_of_each_keeps_the_smallest(spark):
    rows = documents(6, 40)
    kept = {r["doc_id"] for r in simhash.one_of_each(table_of(spark, rows)).collect()}
    least = {eval(g)[2] for g in brute_groups(rows)}
    assert kept == least


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 100), (7, 7)], [((i * 7) % 50, (i * 11) % 50) for i in range(60)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {i: find(i) for i in root}


def test_a_large_bucket_without_a_large_component(spark, monkeypatch):
    """Thousands that share a key, in small groups: both sides are cut, links are those of brute force, and no part has more than its share."""
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 150)
    rng = np.random.default_rng(3)
    base = 0x123456789 << 23  # the segments B and C, that all share
    centres = rng.choice(1 << 23, 700, replace=False)
    fps = np.unique(np.concatenate([centres, *[centres ^ (1 << rng.integers(0, 23, 700)) ^ (1 << rng.integers(0, 23, 700)) for _ in range(3)]])) | base
    frame = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.linked(frame).collect()}
    group = {int(f): int(f) for f in fps}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, f in enumerate(fps):
        close = fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ f) <= 4]
        for g in close.tolist():
            a, b = top(int(f)), top(g)
            group[max(a, b)] = min(a, b)
    want = {f: top(f) for f in map(int, fps)}
    assert {f: got.get(f, f) for f in want} == want and len(set(want.values())) > 1
