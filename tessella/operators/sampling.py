"""Weighted sampling without replacement, weights, hardness, and dealing rows out.

Random numbers are hashes of a key and a seed, so the same rows are drawn
however they are partitioned, and on a retry.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoints import staged
from .usage import COUNTS


def uniform(*keys: Column | str) -> Column:
    """A number strictly between 0 and 1, from the keys' text."""
    text = F.concat_ws("|", *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys])
    return (F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("double") + 1) / F.lit(4294967297.0)


def usage_weight(count: Column, alpha: float = 4.0) -> Column:
    """R2: images that were used often weigh less."""
    return 1 / (1 + alpha * F.coalesce(count, F.lit(0)))


def draw_key(weight: Column, u: Column) -> Column:
    """The smallest keys make a weighted sample without replacement (an exponential clock for each row)."""
    return -F.ln(u) / F.greatest(weight, F.lit(1e-12))


def weighted_sample(df: DataFrame, weight: Column, k: int, seed: int, key: str) -> DataFrame:
    """``k`` rows, each drawn with a chance by its weight; all rows if there are fewer."""
    return df.withColumn("draw", draw_key(weight, uniform(F.lit(seed), key))).orderBy("draw", key).limit(k)


def weighted_sample_by(df: DataFrame, group: str, weight: Column, k: int | Column, seed: int, key: str) -> DataFrame:
    """R1 within groups: a rank limit below each group's window, so only k rows of a group survive each task."""
    ranked = df.withColumn("draw", draw_key(weight, uniform(F.lit(seed), group, key))).withColumn("draw_rank", F.row_number().over(Window.partitionBy(group).orderBy("draw", key)))
    return ranked.where(F.col("draw_rank") <= k)


def with_shape(df: DataFrame, cap: float = 1024.0 * 1024.0) -> DataFrame:
    """Area, aspect ratio, and the area after the cap."""
    area = (F.col("img_width") * F.col("img_height")).cast("double")
    shaped = df.withColumns({"area": area, "ratio": F.col("img_width") / F.greatest(F.lit(1), F.col("img_height"))})
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(cap)) / F.greatest(F.lit(1.0), F.col("area"))))
    return shaped.withColumn("pre_scale", scale).withColumn("area_eff", F.col("area") * F.col("pre_scale") * F.col("pre_scale"))


def pressure(rho: Column, area_eff: Column, lambda_down: float = 0.22, rho_max: float = 2e-4) -> Column:
    """The canvas area that an object of share rho asks for."""
    return F.when(rho > 0, rho * lambda_down * area_eff / rho_max).otherwise(F.lit(0.0))


def min_max(c: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; 0 where all values are the same."""
    return F.when(high > low, (c - low) / (high - low)).otherwise(F.lit(0.0))


def with_hardness(df: DataFrame) -> DataFrame:
    """P10: scaled pressure, and a fifth of how far the aspect ratio is from square.  The bounds are one row, broadcast."""
    bounds = df.agg(F.min("pressure").alias("_low"), F.max("pressure").alias("_high"))
    joined = df.crossJoin(F.broadcast(bounds))  # a single row
    odd = F.least(F.lit(2.0), F.abs(F.ln(F.greatest(F.col("ratio"), F.lit(1e-9))))) / 2
    return joined.withColumn("hardness", min_max(F.col("pressure"), F.col("_low"), F.col("_high")) + 0.2 * odd).drop("_low", "_high")


def hard_threshold(df: DataFrame, q: float = 0.66) -> DataFrame:
    """The quantile of hardness above which an image is hard; the largest value of two rows or fewer.

    The two values beside the quantile's place are found by their numbers in
    sorted ranges, so no task holds all distinct values.  Null counts as none.
    """
    ranked = numbered(df.select("hardness").where(F.col("hardness").isNotNull()), "hardness")
    rows = ranked.count()
    place = (rows - 1) * q if rows > 2 else rows - 1
    low, share = math.floor(place), place - math.floor(place)
    beside = ranked.where(F.col("ordinal").isin(low, low + 1)).agg(F.min("hardness").alias("a"), F.max("hardness").alias("b"))
    return beside.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - share) + F.col("b") * share).alias("threshold"))


def with_bucket(df: DataFrame) -> DataFrame:
    """Hard (strictly above the threshold) or easy."""
    return df.crossJoin(F.broadcast(hard_threshold(df))).withColumn("bucket", F.when(F.col("hardness") > F.col("threshold"), "hard").otherwise("easy")).drop("threshold")


def pressure_discount(weight: Column, scaled: Column) -> Column:
    """Heavy images weigh up to 40 % less."""
    return weight * (1 - 0.4 * scaled)


def hard_share(k: int) -> int:
    """Two fifths of k, halves to the even number."""
    return round(0.4 * k)


def sample_mixed(df: DataFrame, k: int, weight: Column, seed: int, key: str) -> DataFrame:
    """Two fifths hard and three fifths easy images; what one side lacks is filled from all that are left."""
    hard = hard_share(k)
    ranked = df.withColumn("draw", draw_key(weight, uniform(F.lit(seed), key)))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy("draw", key)))
    quota = F.when(F.col("bucket") == "hard", hard).otherwise(k - hard)
    # within its own quota first; the rest wait in the order of their keys
    return ranked.where(F.col("r") <= k).withColumn("spare", F.col("r") > quota).orderBy("spare", "draw", key).limit(k).drop("r")


def band_weight(ratio: Column, wanted: Column, weight: Column) -> Column:
    """Usage weight, less the further the aspect ratio is off."""
    return weight / (1 + 0.8 * F.abs(F.ln(ratio / wanted)))


def layout_ids(df: DataFrame, canvas: str, *order: str) -> DataFrame:
    """Numbers from 1 on each canvas, by row, column and order of insertion."""
    return df.withColumn("layout_id", F.row_number().over(Window.partitionBy(canvas).orderBy(*order)))


def dealt(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """Rows dealt to n chunks in turn.

    Numbers come from ranges of the order, so the whole table is never one window.
    """
    return numbered(df, *order).withColumn("chunk", (F.col("ordinal") % n).cast("int"))


def numbered(df: DataFrame, *order: Column | str, partitions: int | None = None) -> DataFrame:
    """Dense numbers from 0 in an order, without one task seeing all rows.

    Rows are sorted over a fixed number of ranges, and written with their range
    and their place in it: ranges come from a sample, so a second run might cut
    them otherwise.  The ranges' sizes (as many numbers as there are partitions)
    give the offsets.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    placed = staged(placed.withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id"), "numbered")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for i in range(n):
        starts.append(total)
        total += sizes.get(i, 0)
    offset = F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_part"))
    return placed.withColumn("ordinal", F.col("_place") + offset).drop("_part", "_place")


def recent(df: DataFrame, group: str, order: str, key: str, most: int = 64) -> DataFrame:
    """What was used in the last ``most`` rows before each."""
    return df.withColumn("recent", F.collect_set(key).over(Window.partitionBy(group).orderBy(order).rowsBetween(-most, -1)))


def offsets(df: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Where each share starts: the sizes before it."""
    return df.withColumn("start", F.coalesce(F.sum(size).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def quotas(total: int, n: int, most: int) -> list[int]:
    """At most ``n * most``, dealt evenly from the left."""
    total = min(total, n * most)
    return [total // n + (i < total % n) for i in range(n)]


def balance_score(core: Column, alt: Column, fill: Column) -> Column:
    """Which roles an image was used in, core before alt before fill, less all its uses."""
    core, alt, fill = (F.coalesce(c.cast("long"), F.lit(0)) for c in (core, alt, fill))
    used = lambda c, weight: F.when(c > 0, weight).otherwise(0)
    return used(core, 10_000_000) + used(alt, 10_000) + used(fill, 10) - (core + alt + fill)


def balanced(df: DataFrame, n: int, *ties: Column | str) -> DataFrame:
    """Rows in falling order of their score, dealt to n chunks in turn over the whole table."""
    return dealt(df, n, balance_score(*[F.col(c) for c in COUNTS]).desc(), *ties).drop("ordinal")


def lexi_runs(counts: dict[tuple[int, int, int], int], n: int) -> list[tuple[int, int]]:
    """(chunk, rows) in the order of dealing, from the number of rows of each (core, alt, fill) used.

    A row goes to the chunk whose sums of core, alt and fill, and then whose size
    (all differences after taking the row), are nearest to the average.  Only the
    chunk that takes rows changes, and its distance falls and then rises, so the
    number of rows until another is nearer is found by halving.
    """
    total = sum(counts.values())
    average = [sum(c * v[i] for v, c in counts.items()) / n for i in range(3)]
    sums, sizes, out = [[0, 0, 0] for _ in range(n)], [0] * n, []

    def after(k: int, v: tuple[int, int, int], j: int) -> tuple:
        return (*[abs(sums[k][i] + j * v[i] - average[i]) for i in range(3)], abs(sizes[k] + j - total / n) * 0.05, k)

    for v in sorted(counts, key=lambda v: (-sum(v), tuple(-x for x in v))):
        left = counts[v]
        while left:
            best, *others = sorted(after(k, v, 1) for k in range(n))
            k, m = best[-1], left
            if others:
                first = next((i for i in range(3) if v[i]), None)
                room = total / n - sizes[k] if first is None else average[first] - sums[k][first]
                m = min(left, max(1, int(room)))
                high = left + 1
                while high - m > 1:
                    middle = (m + high) // 2
                    m, high = (middle, high) if after(k, v, middle) < others[0] else (m, middle)
            sums[k], sizes[k], left = [s + m * x for s, x in zip(sums[k], v, strict=True)], sizes[k] + m, left - m
            if out and out[-1][0] == k:
                out[-1] = (k, out[-1][1] + m)
            else:
                out.append((k, m))
    return out


def balanced_lexi(df: DataFrame, n: int, *ties: Column | str) -> DataFrame:
    """D26 over the whole table: rows with most roles used first (of as many, core before alt before fill, then ``ties``), dealt by ``lexi_runs``."""
    flags = [F.when(F.col(c) > 0, 1).otherwise(0) for c in COUNTS]
    rows = df.withColumn("_used", F.array(*flags))
    counts = {tuple(r["_used"]): r["n"] for r in rows.groupBy("_used").agg(F.count(F.lit(1)).alias("n")).collect()}  # 8 at most
    runs, ends, total = lexi_runs(counts, n), [], 0
    for _, m in runs:
        total += m
        ends.append(total)
    placed = numbered(rows.withColumn("_rank", F.aggregate("_used", F.lit(0), lambda a, x: a + x)), F.col("_rank").desc(), F.col("_used").desc(), *ties)
    if not runs:
        return placed.withColumn("chunk", F.lit(0)).drop("_used", "_rank", "ordinal")
    run = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("ordinal")))
    return placed.withColumn("chunk", F.get(F.array(*[F.lit(k) for k, _ in runs]), run)).drop("_used", "_rank", "ordinal")


def balance_lexicographic(rows: list[tuple[str, int, int, int]], n: int) -> list[int]:
    """Each image goes to the chunk with the fewest images, then the least core, alt and fill usage so far.

    Not the reference's rule (that is ``balanced_lexi``): a loop over few rows
    that keeps sizes even.
    """
    import heapq

    heap = [(0, 0, 0, 0, i) for i in range(n)]
    out = [0] * len(rows)
    for at in sorted(range(len(rows)), key=lambda i: (tuple(-x for x in rows[i][1:]), rows[i][0])):
        size, core, alt, fill, chunk = heapq.heappop(heap)
        out[at] = chunk
        heapq.heappush(heap, (size + 1, core + rows[at][1], alt + rows[at][2], fill + rows[at][3], chunk))
    return out


ROLE_COUNTS = COUNTS
