"""The shared folder and what is kept there."""

import os

import pytest
from pyspark.sql import functions as F

from tessella.llm import support


def test_staged_tables_lie_in_the_folder_of_the_session_and_can_be_discarded(spark):
    folder = spark.conf.get(support.CHECKPOINT_KEY)
    df = support.staged(spark.range(5), "t")
    path = df._staged_at
    assert path.startswith(folder.rstrip("/")) and df.count() == 5
    support.discard(spark.range(3), df)
    assert not os.path.exists(path.removeprefix("file://"))


class Unset:
    def get(self, key, default):
        return default


def test_an_unset_folder_is_made_once():
    class Session:
        conf, sparkContext = Unset(), type("Context", (), {"master": "local[2]"})()

    folder = support.shared_folder(Session)
    assert os.path.isdir(folder) and support.shared_folder(Session) == folder


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host"])
def test_an_unset_folder_on_a_cluster_is_an_error(master):
    class Session:
        conf, sparkContext = Unset(), type("Context", (), {"master": master})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        support.shared_folder(Session)


def test_tables_staged_on_the_way_are_deleted(spark):
    inner = []

    def make():
        inner.append(support.staged(spark.range(5), "inner"))
        return inner[0].where("id > 1")

    before = support.staged(spark.range(2), "before")
    out = support.staged_alone(make, "outer")
    exists = lambda df: os.path.exists(df._staged_at.removeprefix("file://"))
    assert out.count() == 3 and exists(out) and exists(before) and not exists(inner[0])
    support.discard(before, out)


@pytest.mark.parametrize("how", ["inner", "left_semi"])
def test_split_joins_equal_joins(spark, how):
    left = support.staged(spark.range(6_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), "id"), "left")
    right = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    rows = lambda df: sorted(map(tuple, df.select(sorted(df.columns)).collect()))
    assert rows(support.split_join(left, right, ["k"], how)) == rows(left.join(right, "k", how))
    support.discard(left)


def test_a_batch_size_of_the_session_is_left_alone(spark):
    was = spark.conf.get(support.BATCH_KEY)
    spark.conf.set(support.BATCH_KEY, "10000")
    try:
        assert support.shipped(spark).conf.get(support.BATCH_KEY) == "10000"
    finally:
        spark.conf.set(support.BATCH_KEY, was)


def test_package_is_shipped_once(spark):
    mark = support.shipped(spark).sparkContext._tessella_shipped
    assert support.shipped(spark).sparkContext._tessella_shipped == mark


@pytest.mark.parametrize("rows", [0, 5, 50, 5_000])
def test_the_smallest_hashes(spark, rows):
    df = spark.range(rows).select("id", F.xxhash64("id").alias("h"))
    want = [r["id"] for r in df.orderBy("h", "id").limit(40).collect()]
    assert [r["id"] for r in support.smallest(df, F.xxhash64("id"), 40, "id").collect()] == want
    alike = spark.range(rows).select("id", F.lit(1).alias("k"))
    assert support.smallest(alike, F.xxhash64("k"), 40, "id").count() == min(40, rows)


@pytest.mark.parametrize("lacking", ["xxhash", "ahocorasick", "numpy"])
def test_what_the_subpackage_lacks_is_an_error_and_not_its_absence(lacking):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(support.__file__).parents[2]
    run = subprocess.run([sys.executable, "-c", f"import sys; sys.modules['{lacking}'] = None; import __spark_entry__"], cwd=root, capture_output=True, text=True, timeout=60)
    assert run.returncode != 0 and lacking in run.stderr
