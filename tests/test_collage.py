"""Sampling, dealing, range joins, packing and rounds."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessella.operators import bandjoin, collage, sampling, usage
from tessella.plans import commands
from tessella.sources import readers


def test_weighted_sample_prefers_weight_and_is_deterministic(spark):
    rows = spark.range(2000).withColumn("w", F.when(F.col("id") < 1000, 1.0).otherwise(4.0))
    first = {r["id"] for r in sampling.weighted_sample(rows, F.col("w"), 400, 1, "id").collect()}
    again = {r["id"] for r in sampling.weighted_sample(rows.repartition(7), F.col("w"), 400, 1, "id").collect()}
    assert first == again and len(first) == 400
    assert 2.5 < sum(i >= 1000 for i in first) / max(1, sum(i < 1000 for i in first)) < 6
    assert sampling.weighted_sample(rows, F.col("w"), 5000, 1, "id").count() == 2000


def test_mixed_sample_fills_what_is_lacking(spark):
    rows = spark.range(20).withColumn("bucket", F.when(F.col("id") < 2, "hard").otherwise("easy"))
    got = sampling.sample_mixed(rows, 10, F.lit(1.0), 3, "id").collect()
    assert len(got) == 10 and sum(r["bucket"] == "hard" for r in got) == 2
    assert sampling.hard_share(5) == 2 and sampling.hard_share(10) == 4


def test_numbers_are_dense_and_in_order(spark):
    rows = sampling.numbered(spark.range(1000).withColumn("x", (F.col("id") * 7919) % 1000), "x").collect()
    assert [r["x"] for r in sorted(rows, key=lambda r: r["ordinal"])] == list(range(1000))
    assert sampling.numbered(spark.range(0).withColumn("x", F.col("id")), "x").count() == 0


def test_quotas():
    assert sampling.quotas(10, 4, 5) == [3, 3, 2, 2]
    assert sampling.quotas(100, 4, 5) == [5, 5, 5, 5]


def test_band_join_equals_the_nested_loop(spark):
    rng = np.random.default_rng(1)
    panels = spark.createDataFrame([(i, float(a), float(r)) for i, (a, r) in enumerate(zip(np.exp(rng.uniform(5, 12, 60)), np.exp(rng.uniform(-2, 2, 60)), strict=True))], "panel_id long, panel_area double, panel_ratio double")
    images = spark.createDataFrame([(i, float(a), float(r)) for i, (a, r) in enumerate(zip(np.exp(rng.uniform(5, 12, 500)), np.exp(rng.uniform(-2, 2, 500)), strict=True))], "uid long, area double, ratio double")
    got = {(r["panel_id"], r["uid"]) for r in bandjoin.band_join(panels, images).collect()}
    want = {(r["panel_id"], r["uid"]) for r in panels.crossJoin(images).where(bandjoin.fits(F.col("area"), F.col("ratio"), F.col("panel_area"), F.col("panel_ratio"))).collect()}
    assert got == want and want
    assert bandjoin.band_join(panels, images).count() == len(want)


def test_hardness_of_equal_images_is_flat(spark):
    rows = sampling.with_hardness(spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "pressure double, ratio double"))
    assert {r["hardness"] for r in rows.collect()} == {0.0}


def greedy(flags, n):
    """The rule, row by row: the chunk nearest to the average of core, alt and fill, then of size."""
    average, size = [sum(v[i] for v in flags) / n for i in range(3)], len(flags) / n
    sums, sizes, out = [[0, 0, 0] for _ in range(n)], [0] * n, []
    for v in flags:
        k = min(range(n), key=lambda k: (*[abs(sums[k][i] + v[i] - average[i]) for i in range(3)], abs(sizes[k] + 1 - size) * 0.05))
        sums[k], sizes[k] = [a + b for a, b in zip(sums[k], v, strict=True)], sizes[k] + 1
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_lexi_runs_equal_the_rule_row_by_row(seed):
    r = random.Random(seed)
    flags = sorted((tuple(int(r.random() < p) for p in (0.1 * seed, 0.3, 0.6)) for _ in range(r.randint(1, 700))), key=lambda v: (-sum(v), tuple(-x for x in v)))
    for n in (1, 2, 5, 8):
        runs = sampling.lexi_runs(dict(Counter(flags)), n)
        assert [k for k, m in runs for _ in range(m)] == greedy(flags, n)


def test_balances_hold_over_the_whole_table(spark):
    r = random.Random(2)
    rows = [(f"u{i}", *[r.choice([0, 0, 1, 7]) for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "uid string, core_count long, alt_count long, fill_count long")
    flags = sorted((tuple(int(x > 0) for x in row[1:]) for row in rows), key=lambda v: (-sum(v), tuple(-x for x in v)))
    got = sampling.balanced_lexi(df, 4, "uid").collect()
    assert Counter((x["chunk"], tuple(int(x[c] > 0) for c in sampling.COUNTS)) for x in got) == Counter(zip(greedy(flags, 4), flags, strict=True))
    order = sorted(rows, key=lambda x: (-(10**7 * (x[1] > 0) + 10**4 * (x[2] > 0) + 10 * (x[3] > 0) - sum(x[1:])), x[0]))
    assert {x["uid"]: x["chunk"] for x in sampling.balanced(df, 4, "uid").collect()} == {x[0]: i % 4 for i, x in enumerate(order)}


def test_lexicographic_balance_is_even():
    rows = [(str(i), i % 5, i % 3, i % 2) for i in range(40)]
    out = sampling.balance_lexicographic(rows, 8)
    assert [out.count(i) for i in range(8)] == [5] * 8


def pool_frame(n=300, seed=0):
    rng = np.random.default_rng(seed)
    w, h = rng.integers(240, 1800, n), rng.integers(240, 1500, n)
    return pd.DataFrame(
        {"uid": [str(i) for i in range(n)], "image": [f"{i}.jpg" for i in range(n)], "img_width": w, "img_height": h, "rho": np.where(rng.random(n) < 0.3, 1e-5, 0.0), "bx0": 1.0, "by0": 2.0, "bx1": 9.0, "by1": 8.0,
         "question": "q", "answer": "a", "core_count": 0, "alt_count": 0, "fill_count": 0}
    )


def check(made, s):
    w, h = made["canvas"]["width"], made["canvas"]["height"]
    rects = [tuple(x["layout_bbox"]) for x in made["layouts"]]
    for r in rects:
        assert 0 <= r[0] < r[2] <= w and 0 <= r[1] < r[3] <= h and min(r[2] - r[0], r[3] - r[1]) >= s.min_short_edge
    for i, a in enumerate(rects):
        assert not any(collage.overlap(a, b) for b in rects[i + 1 :])
    fills = [x["src_img"] for x in made["layouts"] if x["image_type"] == "fill"]
    assert len(fills) == len(set(fills))
    assert [x["layout_id"] for x in made["layouts"]] == list(range(1, len(rects) + 1))
    for x in made["layouts"]:
        if x["image_type"] != "fill":
            if x["object_bbox_ratio"] > 0:
                assert x["object_bbox_ratio"] * x["layout_area"] / (w * h) <= s.rho_max + 1e-12
            else:
                assert x["scale_ratio"] >= s.lambda_down - 1e-9
    for x in made["layouts"]:
        b, on = x["layout_bbox"], x["canvas_object_bbox"]
        assert b[0] <= on[0] <= on[2] <= b[2] and b[1] <= on[1] <= on[3] <= b[3]


def test_collages_are_sound_and_deterministic():
    s = collage.Settings()
    made = [collage.make(collage.Pool(pool_frame(), s), i, 5, s) for i in range(12)]
    found = [m for m in made if m]
    assert found
    for m in found:
        check(m, s)
    again = [collage.make(collage.Pool(pool_frame(), s), i, 5, s) for i in range(12)]
    assert made == again


def test_too_few_images_give_no_collage():
    s = collage.Settings()
    assert collage.make(collage.Pool(pool_frame(2), s), 0, 1, s) is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 5), st.integers(1, 5)), min_size=1, max_size=5))
def test_free_rectangles_never_overlap_used_ones(used):
    free = [(0, 0, 10, 10)]
    rects = [(x, y, min(10, x + w), min(10, y + h)) for x, y, w, h in used]
    for r in rects:
        free = collage.split_free(free, r)
    assert not any(collage.overlap(f, r) for f in free for r in rects)


def table(spark, n=400):
    return spark.createDataFrame(pool_frame(n)[["uid", "image", "img_width", "img_height", "question", "answer"]]).withColumn("bbox", F.lit("[1, 2, 9, 8]"))


def test_rounds_count_uses_and_go_on(spark, tmp_path):
    images = table(spark)
    out = commands.collages(spark, images, str(tmp_path), 6, 4, 2, seed=3)
    used = out.agg(*[F.sum(c).alias(c) for c in usage.COUNTS]).first()
    layouts = readers.sidecars(spark, str(tmp_path / "layouts"), lines=True)
    counted = usage.counts_from_layouts(layouts).agg(*[F.sum(c).alias(c) for c in usage.COUNTS]).first()
    assert tuple(used) == tuple(counted) and used["core_count"] > 0
    from tessella.sources import resume

    again, start = resume.prepare(images, str(tmp_path))
    assert start >= 1 and tuple(again.agg(*[F.sum(c) for c in usage.COUNTS]).first()) == tuple(used)


def test_a_run_that_can_make_nothing_ends(spark):
    rounds = list(collage.make_all(table(spark, 2), 10, 5, 2, empty_rounds=2))
    assert len(rounds) == 2 and rounds[-1][1].count() == 0


def test_objects_keep_to_their_share():
    s, frame = collage.Settings(), pool_frame(200)
    frame["rho"] = 3e-4
    made = [m for i in range(10) if (m := collage.make(collage.Pool(frame, s), i, 5, s))]
    assert made
    for m in made:
        check(m, s)


def test_a_large_table_makes_more_chunks(spark, monkeypatch):
    monkeypatch.setattr(collage, "CHUNK_ROWS", 100)
    made = collage.make_round(table(spark), 8, 2, seed=1)
    assert 0 < made.count() <= 8


def test_a_broken_run_goes_on_to_exactly_the_total(spark, tmp_path):
    """Rendered collages; the first run ends early, with a gap in its numbers and a layout without an image."""
    from tessella.operators import rendering
    from tessella.sources import resume

    source, out = tmp_path / "src", str(tmp_path / "out")
    source.mkdir()
    frame = pool_frame(300)
    frame["img_width"], frame["img_height"] = frame["img_width"] // 8, frame["img_height"] // 8
    tile = rendering.png(np.full((24, 24, 3), 90, np.uint8))
    for name in frame["image"][:100]:
        (source / name).write_bytes(tile)
    images = spark.createDataFrame(frame[["uid", "image", "img_width", "img_height", "question", "answer"]])
    small = collage.small(min_short_edge=28, area_min=3e6 / 64, area_max=1.2e7 / 64, src_max_area=2**14)
    files = lambda: sorted(int(p.stem) for p in (tmp_path / "out/images").rglob("*.png"))
    commands.collages(spark, images, out, 4, 2, 2, seed=3, settings=small, image_root=str(source))
    assert len(files()) == 4
    (tmp_path / f"out/images/0/{files()[1]}.png").unlink()
    layouts = spark.read.schema(collage.COLLAGE).option("recursiveFileLookup", True).json(f"{out}/layouts")
    from tessella.sources import writers

    writers.write_sidecars(layouts.limit(1).withColumn("collage_index", F.lit(5_000).cast("long")), out)
    assert resume.made(spark, out) == 5 and resume.unrendered(spark, out).count() == 2
    commands.collages(spark, images, out, 8, 2, 2, seed=3, settings=small, image_root=str(source))
    assert len(files()) == 8 == resume.made(spark, out) and max(files()) > 5_000 and not list((tmp_path / "out/images").rglob("*.part"))


@pytest.mark.parametrize("n", [1, 3])
def test_best_fitting(spark, n):
    items = spark.createDataFrame([("c", "i", 2, 2)], "canvas string, item_id string, w long, h long")
    free = spark.createDataFrame([("c", 0, 0, 2, 2), ("c", 0, 0, 9, 9), ("c", 0, 0, 1, 9), ("c", 0, 0, 3, 3)], "canvas string, x0 long, y0 long, x1 long, y1 long")
    assert [r["slack"] for r in bandjoin.best_fitting(items, free, n).orderBy("rank").collect()] == [0, 5, 77][:n]
