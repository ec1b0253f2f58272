"""Queries on usage counts, sampling, exclusion and numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational, sampling, usage
from ..sources.readers import table
from .registry import query

_USED = """
    n AS (SELECT l_partkey AS uid, count(*) FILTER (WHERE l_returnflag = 'A') AS core_count, count(*) FILTER (WHERE l_returnflag = 'N') AS alt_count, count(*) FILTER (WHERE l_returnflag = 'R') AS fill_count FROM lineitem GROUP BY l_partkey),
    u AS (SELECT p_partkey AS uid, coalesce(core_count, 0) AS core_count, coalesce(alt_count, 0) AS alt_count, coalesce(fill_count, 0) AS fill_count FROM part LEFT JOIN n ON p_partkey = uid)
"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images; line items as uses, by their return flag."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("uid")).agg(*[F.count_if(F.col("l_returnflag") == f).alias(c) for f, c in zip("ANR", usage.COUNTS, strict=True)])
    return usage.merge_counts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid")), items)


@query("merge_counts", "WITH " + _USED + " SELECT * FROM u")
def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a checkpoint merged into the image table."""
    return _usage(spark, sf_dir)


@query(
    "add_usage",
    "WITH " + _USED + " , r AS (SELECT o_custkey AS uid, count(*) AS n FROM orders GROUP BY o_custkey) SELECT u.uid, core_count + coalesce(n, 0) AS core_count, alt_count, fill_count FROM u LEFT JOIN r ON u.uid = r.uid",
)
def add_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round's uses added to the counts."""
    zero = F.lit(0).cast("long")
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.lit(1).cast("long").alias("core_count"), zero.alias("alt_count"), zero.alias("fill_count"))
    return usage.add_usage(_usage(spark, sf_dir), used)


@query(
    "map_legacy_counts",
    """
    WITH o AS (SELECT 'seg' || (o_custkey % 10) AS image, count(*) FILTER (WHERE o_orderstatus = 'F') AS c, count(*) FILTER (WHERE o_orderstatus = 'O') AS a, count(*) FILTER (WHERE o_orderstatus = 'P') AS f FROM orders GROUP BY 1),
    i AS (SELECT DISTINCT 'seg' || (c_custkey % 12) AS image, CAST(c_nationkey AS VARCHAR) AS uid FROM customer)
    SELECT uid, CAST(sum(c) AS BIGINT) AS core_count, CAST(sum(a) AS BIGINT) AS alt_count, CAST(sum(f) AS BIGINT) AS fill_count FROM i JOIN o ON i.image = o.image GROUP BY uid
    """,
)
def map_legacy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by image moved to uids."""
    named = lambda c, n: F.concat(F.lit("seg"), (F.col(c) % n).cast("string")).alias("image")
    counts = table(spark, sf_dir, "orders").groupBy(named("o_custkey", 10)).agg(*[F.count_if(F.col("o_orderstatus") == k).alias(c) for k, c in zip("FOP", usage.COUNTS, strict=True)])
    images = table(spark, sf_dir, "customer").select(named("c_custkey", 12), F.col("c_nationkey").cast("string").alias("uid"))
    return usage.map_legacy_counts(images, counts)


_ROLES = " , x AS (SELECT 'core' AS role, core_count AS n FROM u UNION ALL SELECT 'alt', alt_count FROM u UNION ALL SELECT 'fill', fill_count FROM u)"


@query(
    "usage_overview",
    "WITH "
    + _USED
    + _ROLES
    + """
    SELECT role, count(*) AS total, count(*) FILTER (WHERE n > 0) AS used, count(*) FILTER (WHERE n = 0) AS unused, CAST(sum(n) AS BIGINT) AS sum, avg(n) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS min, max(n) AS max,
           quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99 FROM x GROUP BY role
    """,
)
def usage_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often images were used, by role."""
    return usage.overview(_usage(spark, sf_dir))


@query("usage_histogram", "WITH " + _USED + _ROLES + ' SELECT role, n AS "count", count(*) AS num_images FROM x GROUP BY role, n')
def usage_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images were used how often."""
    return usage.histogram(_usage(spark, sf_dir))


@query("any_usage", "WITH " + _USED + " SELECT sum(core_count) + sum(alt_count) + sum(fill_count) > 0 AS used FROM u")
def any_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether anything was used."""
    return usage.any_usage(_usage(spark, sf_dir))


_KINDS = "CASE l_linenumber % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'alt' ELSE 'fill' END"


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "CORE").when(F.col("l_linenumber") % 3 == 1, "alt").otherwise("fill")
    image = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    layout = F.struct(F.when(F.col("l_orderkey") % 2 == 0, image).alias("src_img"), F.when(F.col("l_orderkey") % 2 == 1, image).alias("image"), kind.alias("image_type"))
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(layout).alias("all"))
    return grouped.select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, F.col("all")).alias("layouts"), F.when(F.col("l_orderkey") % 2 == 1, F.col("all")).alias("placements"))


@query(
    "sidecar_counts",
    f"SELECT 'p' || l_partkey AS image, count(*) FILTER (WHERE {_KINDS} = 'core') AS core_count, count(*) FILTER (WHERE {_KINDS} = 'alt') AS alt_count, count(*) FILTER (WHERE {_KINDS} = 'fill') AS fill_count FROM lineitem GROUP BY l_partkey",
)
def sidecar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses by image, from sidecars in the present and the earlier form."""
    return usage.counts_from_layouts(_sidecars(spark, sf_dir))


@query(
    "type_counts",
    f"SELECT l_orderkey, count(*) AS layout_count, count(*) FILTER (WHERE {_KINDS} = 'core') AS core_count, count(*) FILTER (WHERE {_KINDS} = 'alt') AS alt_count, count(*) FILTER (WHERE {_KINDS} = 'fill') AS fill_count FROM lineitem GROUP BY l_orderkey",
)
def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: layouts of each kind on a canvas."""
    return _sidecars(spark, sf_dir).select("l_orderkey", usage.layout_counts(F.coalesce("layouts", "placements")).alias("c")).select("l_orderkey", "c.*")


@query("anti_selected", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)")
def anti_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that weren't selected."""
    used = table(spark, sf_dir, "lineitem").where("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"))
    return relational.excluding(table(spark, sf_dir, "part").select("p_partkey"), used, "p_partkey")


@query("anti_by_path", "SELECT p_partkey FROM part WHERE p_name <> '' AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 49)")
def anti_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose path isn't on the canvas yet."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("image"), "p_size")
    return relational.excluding(relational.valid_images(parts), parts.where("p_size > 49"), "image").select("p_partkey")


@query("semi_selected", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def semi_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images that were selected."""
    used = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    return relational.only(table(spark, sf_dir, "part").select("p_partkey"), used, "p_partkey")


_SHAPED = """
    s AS (SELECT p_partkey AS uid, CAST(p_size * 40 AS DOUBLE) * (p_partkey % 900 + 60) AS area, CAST(p_size * 40 AS DOUBLE) / (p_partkey % 900 + 60) AS ratio, CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE p_retailprice / 1e7 END AS rho FROM part),
    e AS (SELECT *, area * power(least(1.0, sqrt(1048576.0 / greatest(1.0, area))), 2) AS area_eff FROM s),
    q AS (SELECT *, CASE WHEN rho > 0 THEN rho * 0.22 * area_eff / 2e-4 ELSE 0.0 END AS pressure FROM e),
    h AS (SELECT uid, area_eff, pressure, (pressure - min(pressure) OVER ()) / (max(pressure) OVER () - min(pressure) OVER ()) + 0.2 * least(2.0, abs(ln(ratio))) / 2 AS hardness FROM q)
"""


def _hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), (F.col("p_size") * 40).alias("img_width"), (F.col("p_partkey") % 900 + 60).alias("img_height"), F.when(F.col("p_partkey") % 4 == 0, 0.0).otherwise(F.col("p_retailprice") / 1e7).alias("rho"))
    shaped = sampling.with_shape(parts)
    return sampling.with_hardness(shaped.withColumn("pressure", sampling.pressure(F.col("rho"), F.col("area_eff"))))


@query("pressure_hardness", "WITH " + _SHAPED + " SELECT uid, round(area_eff, 4) AS area_eff, round(pressure, 4) AS pressure, round(hardness, 9) AS hardness FROM h")
def pressure_hardness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped areas, pressure and hardness."""
    return _hardness(spark, sf_dir).select("uid", F.round("area_eff", 4).alias("area_eff"), F.round("pressure", 4).alias("pressure"), F.round("hardness", 9).alias("hardness"))


@query("hard_bucket", "WITH " + _SHAPED + " SELECT uid, CASE WHEN hardness > (SELECT quantile_cont(hardness, 0.66) FROM h) THEN 'hard' ELSE 'easy' END AS bucket FROM h")
def hard_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard and easy images."""
    return sampling.with_bucket(_hardness(spark, sf_dir)).select("uid", "bucket")


_U = "((('0x' || substr(md5('{seed}|' || {key}), 1, 8))::BIGINT + 1) / 4294967297.0)"


@query("weighted_sample", "WITH " + _USED + " SELECT uid FROM u ORDER BY -ln(" + _U.format(seed=42, key="uid") + ") / (1.0 / (1 + 4 * core_count)), uid LIMIT 100")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred images, less used ones first in chance; the size is the feature."""
    return sampling.weighted_sample(_usage(spark, sf_dir), sampling.usage_weight(F.col("core_count")), 100, 42, "uid").select("uid")


@query(
    "weighted_sample_by",
    """
    WITH d AS (SELECT c_nationkey, c_custkey, -ln("""
    + _U.format(seed=7, key="c_nationkey || '|' || c_custkey")
    + """) / greatest(1e-12, abs(c_acctbal)) AS draw FROM customer)
    SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY draw, c_custkey) AS INTEGER) AS draw_rank FROM d QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY draw, c_custkey) <= 5
    """,
)
def weighted_sample_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each group, by weight."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return sampling.weighted_sample_by(rows, "c_nationkey", F.abs("c_acctbal"), 5, 7, "c_custkey").select("c_nationkey", "c_custkey", "draw_rank")


@query(
    "sample_mixed",
    "WITH "
    + _SHAPED
    + " , b AS (SELECT uid, CASE WHEN hardness > (SELECT quantile_cont(hardness, 0.66) FROM h) THEN 'hard' ELSE 'easy' END AS bucket FROM h), d AS (SELECT *, -ln("
    + _U.format(seed=11, key="uid")
    + ") / (1.0 / (1 + 4 * (uid % 3))) AS draw FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY draw, uid) AS r FROM d) SELECT uid, bucket FROM r ORDER BY r > CASE bucket WHEN 'hard' THEN 10 ELSE 15 END, draw, uid LIMIT 25",
)
def sample_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fifths hard, three fifths easy."""
    rows = sampling.with_bucket(_hardness(spark, sf_dir))
    return sampling.sample_mixed(rows, 25, sampling.usage_weight(F.col("uid") % 3), 11, "uid").select("uid", "bucket")


@query("round_robin_split", "SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1) % 8 AS INTEGER) AS chunk FROM part")
def round_robin_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt to eight chunks in the order of their weight."""
    return sampling.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), 8, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_partkey", "chunk")


@query("row_ordinal", "SELECT n_nationkey, r_name, row_number() OVER (ORDER BY r_name, n_nationkey) - 1 AS ordinal FROM nation JOIN region ON n_regionkey = r_regionkey")
def row_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers in an order."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return sampling.numbered(rows, "r_name", "n_nationkey")


@query("offsets", "SELECT l_orderkey, l_linenumber, CAST(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lineitem")
def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each share starts."""
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", order.alias("place"), F.col("l_quantity").cast("long").alias("n"))
    return sampling.offsets(rows, "l_orderkey", "place", "n").select("l_orderkey", "l_linenumber", "start")


@query(
    "cooldown",
    "SELECT event_id, len(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING))) AS n_recent FROM events",
)
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many kinds were used in the last 64."""
    rows = sampling.recent(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")
    return rows.select("event_id", F.when(F.size("recent") > 0, F.size("recent").cast("long")).alias("n_recent"))


@query("seeded_shuffle", "SELECT p_partkey, row_number() OVER (ORDER BY " + _U.format(seed=5, key="p_partkey") + ", p_partkey) - 1 AS ordinal FROM part")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full shuffle that a seed decides."""
    rows = table(spark, sf_dir, "part").select("p_partkey").withColumn("u", sampling.uniform(F.lit(5), "p_partkey"))
    return sampling.numbered(rows, "u", "p_partkey").select("p_partkey", "ordinal")


@query("composite_order", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_extendedprice DESC, l_linenumber) AS INTEGER) AS place FROM lineitem")
def composite_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, O3: boxed ones first, then by area."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy(F.desc(F.col("l_returnflag") == "R"), F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("place"))


@query(
    "balance_weighted",
    """
    WITH u AS (SELECT l_partkey AS uid, count(*) FILTER (WHERE l_returnflag = 'A') AS c, count(*) FILTER (WHERE l_returnflag = 'N') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS f FROM lineitem GROUP BY l_partkey)
    SELECT uid, CAST((row_number() OVER (ORDER BY (CASE WHEN c > 0 THEN 10000000 ELSE 0 END) + (CASE WHEN a > 0 THEN 10000 ELSE 0 END) + (CASE WHEN f > 0 THEN 10 ELSE 0 END) - (c + a + f) DESC, uid) - 1) % 8 AS INTEGER) AS chunk FROM u
    """,
)
def balance_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All images dealt to eight chunks in turn, in the order of the roles they were used in and of all their uses."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("uid")).agg(*[F.count_if(F.col("l_returnflag") == f).alias(c) for f, c in zip("ANR", sampling.COUNTS, strict=True)])
    return sampling.balanced(rows, 8, "uid").select("uid", "chunk")


@query(
    "source_mixing",
    """
    WITH s(lang, w, i) AS (VALUES ('en', 5, 1), ('de', 3, 2), ('fr', 2, 3)),
    d AS (SELECT doc_id, lang, w, i, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS number, count(*) OVER (PARTITION BY lang) AS have FROM documents JOIN s USING (lang)),
    t AS (SELECT min(have * 10 // w) AS total FROM d),
    q0 AS (SELECT lang, w, i, total, total * w // 10 AS whole, row_number() OVER (ORDER BY total * w % 10 DESC, i) AS place FROM s, t),
    q AS (SELECT lang, whole + CASE WHEN place <= total - (SELECT sum(whole) FROM q0) THEN 1 ELSE 0 END AS n FROM q0)
    SELECT doc_id, lang AS data_source, row_number() OVER (ORDER BY (number + 0.5::DOUBLE) / n, i) - 1 AS position FROM d JOIN q USING (lang) WHERE number < n
    """,
)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources in shares of 5, 3 and 2, as many rows as these allow, interleaved evenly."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("data_source"))
    order = F.struct(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    return relational.mixed(rows, {"en": 5, "de": 3, "fr": 2}, order).select("doc_id", "data_source", "position")


@query(
    "pressure_weights",
    """
    WITH a AS (SELECT p_partkey, p_size % 4 AS used, CAST(p_size AS DOUBLE) AS pressure FROM part), b AS (SELECT *, (pressure - (SELECT min(pressure) FROM a)) / ((SELECT max(pressure) FROM a) - (SELECT min(pressure) FROM a)) AS scaled FROM a)
    SELECT p_partkey, round(1.0::DOUBLE / (1 + 4 * used) * (1 - 0.4::DOUBLE * scaled), 12) AS weight FROM b
    """,
)
def pressure_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by use, with up to two fifths off for heavy images."""
    rows = sampling.with_hardness(table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("used"), F.col("p_size").cast("double").alias("pressure"), F.lit(1.0).alias("ratio")))
    return rows.select("p_partkey", F.round(sampling.pressure_discount(F.lit(1.0) / (1 + 4 * F.col("used")), F.col("hardness")), 12).alias("weight"))  # of square images, the scaled pressure
