"""Free space, panels, matching and mixing against plain Python."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.operators import collage, matching, panels, relational


def canvases(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for k in range(rng.randint(1, 9)):
            x, y = rng.randrange(-20, 380, 5), rng.randrange(-20, 240, 5)
            rows.append((c, k, x, y, x + rng.randrange(-5, 190, 5), y + rng.randrange(0, 120, 5)))
    return rows


@pytest.mark.parametrize("least", [1, 20])
def test_the_fold_equals_the_packer_step_by_step(spark, least):
    rows = canvases(3)
    frame = spark.createDataFrame(rows, "canvas long, k long, x0 long, y0 long, x1 long, y1 long")
    got = {r["canvas"]: sorted(tuple(x) for x in r["free"]) for r in panels.free_space(frame, "canvas", 400, 250, ["k"], least).collect()}
    for c in {r[0] for r in rows}:
        free = [(0, 0, 400, 250)]
        for _, _, x0, y0, x1, y1 in sorted(r for r in rows if r[0] == c):
            if x1 > x0 and y1 > y0 and x1 > 0 and y1 > 0 and x0 < 400 and y0 < 250:
                free = [r for r in collage.split_free(free, (max(0, x0), max(0, y0), min(400, x1), min(250, y1))) if min(r[2] - r[0], r[3] - r[1]) >= least]
        assert got[c] == sorted(free)


def test_panels_are_disjoint_and_within_bounds(spark):
    frame = spark.createDataFrame(canvases(4), "canvas long, k long, x0 long, y0 long, x1 long, y1 long")
    free = panels.free_space(frame, "canvas", 400, 250, ["k"], 20)
    spaces = {r["canvas"]: [tuple(x) for x in r["free"]] for r in free.collect()}
    for r in panels.cut_panels(free.withColumn("other", F.lit("x")), "free", 20).collect():
        found = [tuple(x) for x in r["panels"]]
        assert r["other"] == "x" and len(found) >= (1 if spaces[r["canvas"]] else 0)
        for i, a in enumerate(found):
            assert min(a[2] - a[0], a[3] - a[1]) >= 20 and any(f[0] <= a[0] and f[1] <= a[1] and f[2] >= a[2] and f[3] >= a[3] for f in spaces[r["canvas"]])
            assert not any(collage.overlap(a, b) for b in found[i + 1 :])
            w, h = a[2] - a[0], a[3] - a[1]
            assert 0.4 <= w / h <= 2.5 or max(w, h) * min(w, h) < 4 * 800 or min(w, h) < 40
    none = spark.createDataFrame([(1, []), (2, None)], f"canvas long, free {panels.PANELS}")
    assert [r["panels"] for r in panels.cut_panels(none, "free", 20).collect()] == [[], []]


def cut_one_by_one(free, grid=20):
    """D15 as the SQL has it: the largest is taken out of all that wait, parts included, one after another."""
    waiting, done = [f for f in free if min(f[2] - f[0], f[3] - f[1]) >= grid], []
    while waiting:
        u = min(waiting, key=lambda r: (-(r[2] - r[0]) * (r[3] - r[1]), r))
        cut = []
        for f in (w for w in waiting if w != u):
            top, bottom = max(f[1], u[1]), min(f[3], u[3])
            cut += [(f[0], f[1], f[2], u[1]), (f[0], u[3], f[2], f[3]), (f[0], top, u[0], bottom), (u[2], top, f[2], bottom)] if collage.overlap(f, u) else [f]
        cut = [r for r in cut if r[2] > r[0] and r[3] > r[1]]
        waiting = [a for a in cut if sum(b[0] <= a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] >= a[3] for b in cut) == 1 and min(a[2] - a[0], a[3] - a[1]) >= grid]
        w, h = u[2] - u[0], u[3] - u[1]
        at = u[0] + w // (2 * grid) * grid if w >= h else u[1] + h // (2 * grid) * grid
        parts = [(*u[:2], at, u[3]), (at, *u[1:])] if w >= h else [(*u[:3], at), (u[0], at, *u[2:])]
        small = any((p[2] - p[0]) * (p[3] - p[1]) < 2 * grid * grid or min(p[2] - p[0], p[3] - p[1]) < grid for p in parts)
        if 0.4 <= w / h <= 2.5 or small:
            done.append(u)
        else:
            waiting += parts
    return sorted(done)


def test_panels_equal_those_cut_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(panels, "PAIRS", 7)
    rng, spaces = random.Random(5), []
    for c in range(60):  # not only maximal ones: some hold others, some are equal
        rects = [(x, y, x + rng.randrange(10, 400, 5), y + rng.randrange(10, 160, 5)) for x, y in ((rng.randrange(0, 300, 5), rng.randrange(0, 200, 5)) for _ in range(c % 12))]
        spaces.append(rects + rng.choices(rects, k=c % 3) if rects else rects)
    frame = spark.createDataFrame(list(enumerate(spaces)), f"canvas long, free {panels.PANELS}")
    for r in panels.cut_panels(frame, "free", 20).collect():
        assert sorted(tuple(x) for x in r["panels"]) == cut_one_by_one(spaces[r["canvas"]])
    flat = panels.np.array([r for s in spaces for r in s], "int64").T
    own, found = panels._panels(panels.np.array([len(s) for s in spaces]), flat, 20, 0.4, 2.5, 0.5)  # in this process, with few pairs at a time
    for c, s in enumerate(spaces):
        assert sorted(map(tuple, found[:, own == c].T.tolist())) == cut_one_by_one(s)


def test_parts_of_a_panel_take_no_steps_of_their_own(spark, monkeypatch):
    works, steps, without, frame = [], [], panels._without, spark.createDataFrame([], f"canvas long, free {panels.PANELS}")
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, *a, g=type(frame).mapInArrow: works.append(f) or g(self, f, *a))
    monkeypatch.setattr(panels, "_without", lambda *a, **k: steps.append(1) or without(*a, **k))
    panels.cut_panels(frame, "free", 20)
    boxes = pa.StructArray.from_arrays([pa.array(side) for side in ([0, 0], [0, 100], [40 * 256, 60], [40, 140])], ["x0", "y0", "x1", "y1"])
    batch = pa.RecordBatch.from_arrays([pa.array([{"_": 0, "canvas": 1}]), pa.ListArray.from_arrays([0, 2], boxes)], ["row", "free"])
    (found,) = list(works[0](iter([batch])))
    got = sorted(tuple(p.values()) for p in found.to_pylist()[0]["panels"])
    assert got == sorted([(80 * i, 0, 80 * i + 80, 40) for i in range(128)] + [(0, 100, 60, 140)])
    assert len(steps) == 2  # before: one for each panel and each cut, each comparing all that waited


def test_free_space_runs_no_function_row_by_row(spark):
    frame = spark.createDataFrame(canvases(6, 3), "canvas long, k long, x0 long, y0 long, x1 long, y1 long")
    plan = panels.free_space(frame, "canvas", 400, 250, ["k"], 20)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "lambda" not in plan


@pytest.mark.parametrize("scope", [(), ("canvas",)])
def test_matching_equals_choosing_one_after_another(spark, scope):
    rng = random.Random(len(scope))
    rows = []
    for p in range(120):
        uids = rng.sample(range(60), rng.randint(0, 12)) if rng.random() < 0.7 else [7, 8, 9]
        rows += [(p % 9, p, float(p * 7919 % 50), u, i) for i, u in enumerate(uids, 1)]
    frame = spark.createDataFrame(rows, "canvas long, panel_id long, panel_area double, uid long, place int")
    got = sorted((r["panel_id"], r["uid"], r["place"]) for r in matching.matched(frame, scope).collect())
    taken, want = set(), []
    for p in sorted({r[1] for r in rows}, key=lambda p: (-float(p * 7919 % 50), p)):
        for c, _, _, u, i in sorted((r for r in rows if r[1] == p), key=lambda r: r[4]):
            if (c if scope else None, u) not in taken:
                taken.add((c if scope else None, u))
                want.append((p, u, i))
                break
    assert got == sorted(want) and matching.matched(frame.limit(0), scope).count() == 0


def test_shares_are_exact_whatever_the_partitions(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 < 6, "a").when(F.col("id") % 10 < 9, "b").otherwise("c").alias("data_source"))
    first = [(r["id"], r["data_source"]) for r in relational.mixed(rows, {"a": 1, "b": 1}, F.xxhash64("id")).orderBy("position").collect()]
    again = [(r["id"], r["data_source"]) for r in relational.mixed(rows.repartition(7), {"a": 1, "b": 1}, F.xxhash64("id")).orderBy("position").collect()]
    assert first == again and len(first) == 600
    assert [s for _, s in first] == ["a", "b"] * 300  # one to one, in turn
    three = [r["data_source"] for r in relational.mixed(rows, {"c": 1, "a": 2, "b": 4}, F.xxhash64("id"), total=101).orderBy("position").collect()]
    assert {s: three.count(s) for s in "abc"} == {"c": 14, "a": 29, "b": 58}
    for n in range(1, 102):
        assert abs(three[:n].count("b") - n * 58 / 101) <= 1.5
    assert relational.mixed(rows.limit(0), {"a": 1}, F.col("id")).count() == 0


def test_shares_that_are_not_there_are_an_error():
    assert relational.shares_of({"a": 10, "b": 3}, {"a": 2, "b": 1}) == {"a": 6, "b": 3}
    assert relational.shares_of({"a": 10, "b": 10}, {"a": 1, "b": 1}, 7) == {"a": 4, "b": 3}
    with pytest.raises(ValueError, match="fewer rows"):
        relational.shares_of({"a": 2, "b": 10}, {"a": 1, "b": 1}, 8)
