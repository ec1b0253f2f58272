"""Joins on few keys and among copies: the work is spread over tasks, and what is alike is looked at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tessella.operators import bandjoin, collage, matching
from tessella.sources import writers


def largest_share(df) -> float:
    """The share of all rows that comes from one task."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def tables(spark, panels, images):
    """Panels and images of few sizes, so many are alike."""
    p, i = F.col("id"), F.col("id")
    return (
        spark.range(panels).select(p.alias("panel_id"), (20_000.0 + p * 7919 % 50_000).alias("panel_area"), (0.4 + p % 7 * 0.3).alias("panel_ratio")),
        spark.range(images).select(i.alias("uid"), (10_000.0 + i * 37 % 90 * 1_000).alias("area"), (0.3 + i * 53 % 40 * 0.07).alias("ratio")),
    )


def nested(panels, images, tau=bandjoin.TAU):
    return panels.crossJoin(images).where(bandjoin.fits(F.col("area"), F.col("ratio"), F.col("panel_area"), F.col("panel_ratio"), tau))


def test_a_band_join_of_few_buckets_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(bandjoin, "SIDE", 50)
    monkeypatch.setattr(bandjoin, "ALIKE", 3)
    panels, images = tables(spark, 300, 8_000)
    got = bandjoin.band_join(panels, images)
    assert largest_share(got) < 0.4
    assert got.columns == ["panel_id", "panel_area", "panel_ratio", "uid", "area", "ratio"]
    pairs = lambda df: sorted((r["panel_id"], r["uid"]) for r in df.select("panel_id", "uid").collect())
    assert pairs(got) == pairs(nested(panels, images)) and got.count() > 10_000


def bytes_a_row(df, path) -> float:
    """What a row takes in Parquet files, without what each file has besides."""
    df.write.parquet(str(path))
    held = [pq.read_metadata(p) for p in path.glob("part-*.parquet")]
    sizes = [sum(m.row_group(i).column(c).total_compressed_size for c in range(m.num_columns)) for m in held for i in range(m.num_row_groups)]
    return sum(sizes) / sum(m.num_rows for m in held)


def test_pairs_of_overlapping_rectangles_take_little_space_in_files(spark, tmp_path):
    at = lambda n, p, kinds: spark.range(n).select(F.col("id").alias(f"{p}_id"), *[(F.xxhash64(F.col("id") % kinds, F.lit(f"{p}{d}")) % 200 + 200 + far).alias(f"{p}{d}{i}") for i, far in enumerate((0, 90)) for d in "xy"])
    got = bandjoin.overlapping(at(2_000, "a", 2_000), at(6_000, "b", 300)).select("a_id", "b_id")
    assert bytes_a_row(got, tmp_path / "pairs") < 0.3


def test_images_of_one_size_reach_a_join_in_short_arrays_and_leave_it_one_at_a_time(spark):
    """A join hands on all that a row of its left side makes at once: that has to be pairs of sizes, not of images."""
    panels, images = tables(spark, 50, 100_000)
    got = bandjoin.band_join(panels, images)
    assert "Coalesce" in got._jdf.queryExecution().executedPlan().toString()
    assert bandjoin.alike(images, ["area", "ratio"]).agg(F.max(F.size("_rows"))).first()[0] < 250


def test_images_of_one_size_are_counted_without_their_pairs(spark, monkeypatch):
    panels, images = tables(spark, 200, 4_000)
    met, fitting = [], bandjoin.fitting
    monkeypatch.setattr(bandjoin, "fitting", lambda *a: met.append(fitting(*a)) or met[-1])
    got = {r["panel_id"]: r["n"] for r in bandjoin.band_counts(panels, images, 0.8).collect()}
    want = {r["panel_id"]: r["count"] for r in nested(panels, images, 0.8).groupBy("panel_id").count().collect()}
    assert got == want and met[0].count() * 5 < sum(want.values())


def test_overlaps_in_few_cells_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(bandjoin, "SIDE", 50)
    monkeypatch.setattr(bandjoin, "ALIKE", 3)
    rects = lambda n, p, wide: spark.range(n).select(F.col("id").alias(f"{p}_id"), (F.col("id") * 37 % 400).alias(f"{p}x0"), (F.col("id") * 53 % 300).alias(f"{p}y0"), (F.col("id") * 37 % 400 + wide).alias(f"{p}x1"), (F.col("id") * 53 % 300 + F.col("id") % 5 * 20).alias(f"{p}y1"))
    a, b = rects(300, "a", 60), rects(4_000, "b", 30)
    got = bandjoin.overlapping(a, b)
    assert largest_share(got) < 0.4 and got.columns == [*a.columns, *b.columns]
    met = reduce(lambda x, y: x & y, [F.col(f"{p}{d}0") < F.col(f"{q}{d}1") for d in "xy" for p, q in ("ab", "ba", "aa", "bb")])
    pairs = lambda df: sorted((r["a_id"], r["b_id"]) for r in df.select("a_id", "b_id").collect())
    assert pairs(got) == pairs(a.crossJoin(b).where(met)) and got.count() > 10_000


def test_panels_of_one_ratio_ask_once(spark, monkeypatch):
    panels, images = tables(spark, 60, 3_000)
    images = images.withColumn("used", F.when(F.col("uid") % 5 > 0, F.col("uid") % 3))
    labels, staged = [], bandjoin.staged
    monkeypatch.setattr(bandjoin, "staged", lambda df, label: labels.append(label) or staged(df, label))
    got = sorted((r["panel_id"], r["rank"], r["uid"]) for r in bandjoin.nearest_by_score(panels, images, 6, block=7).collect())
    assert labels.count("nearest") == 1  # 60 panels of 7 ratios
    table, want = images.toPandas(), []
    for p in panels.collect():
        score = 1 / (1 + 4 * table["used"].fillna(0)) / (1 + 0.8 * np.abs(np.log(table["ratio"]) - np.log(p["panel_ratio"])))
        want += [(p["panel_id"], n, int(table["uid"][i])) for n, i in enumerate(np.lexsort((table["uid"], -score))[:6], 1)]
    assert got == sorted(want)


def test_the_best_of_many_alike_are_found_without_all_pairs(spark, monkeypatch):
    panels, images = tables(spark, 150, 6_000)
    met, fitting = [], matching.fitting
    monkeypatch.setattr(matching, "fitting", lambda *a: met.append(fitting(*a)) or met[-1])
    weight = F.lit(1.0) / (1 + 4 * (F.col("uid") % 3))
    got = matching.ranked_candidates(panels, images, weight, 3)
    order = F.row_number().over(matching.Window.partitionBy("panel_id").orderBy(F.desc("score"), "uid"))
    all_ = nested(panels, images)
    want = all_.withColumn("score", matching.band_weight(F.col("ratio"), F.col("panel_ratio"), weight)).withColumn("place", order).where("place <= 3")
    rows = lambda df: sorted((r["panel_id"], r["place"], r["uid"], r["score"], r["area"]) for r in df.collect())
    assert rows(got) == rows(want) and got.count() > 300
    assert sum(x.count() for x in met) * 5 < all_.count()


def test_a_shard_of_sidecars_is_one_file(spark, tmp_path):
    rows = spark.range(3_000, numPartitions=6).select((F.col("id") * 7 % 3_000).alias("collage_index"), F.lit(None).cast("struct<width: long>").alias("canvas"), F.array(F.struct(F.lit(1).alias("layout_id"))).alias("layouts"))
    assert writers.write_sidecars(rows, str(tmp_path)) == 3_000
    files = [p for p in (tmp_path / "layouts").rglob("part-*.json")]
    assert len(files) == 3 and sum(len(p.read_text().splitlines()) for p in files) == 3_000


def test_a_draw_sorts_only_what_it_takes(monkeypatch):
    n, sizes, argsort = 5_000, [], np.argsort
    frame = pd.DataFrame({"uid": [str(i) for i in range(n)], "image": [str(i) for i in range(n)], "img_width": 300, "img_height": 200, "rho": 0.0, "core_count": 0, "alt_count": 0, "fill_count": 0})
    pool = collage.Pool(frame, collage.Settings())
    rows, weights = np.arange(n), 1.0 + np.arange(n) % 7
    want = rows[argsort(np.random.default_rng(3).exponential(size=n) / weights, kind="stable")[:9]].tolist()
    monkeypatch.setattr(collage.np, "argsort", lambda a, **k: sizes.append(len(a)) or argsort(a, **k))
    assert pool.draw(rows, weights, 9, np.random.default_rng(3)) == want and sizes == [9]
    assert sorted(pool.draw(rows[:4], weights[:4], 9, np.random.default_rng(3))) == [0, 1, 2, 3]
