"""Queries that write with the sinks and read back with the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import collage, evaluation, usage
from ..sources import readers, resume, writers
from ..sources.checkpoints import scratch, staged
from ..sources.readers import table
from . import commands
from .registry import query


def _folder(spark: SparkSession, label: str) -> str:
    return f"{scratch(spark, label)}/files"


@query(
    "annotations_read",
    """
    SELECT row_number() OVER (ORDER BY page_id) - 1 AS sample_index, html AS question, CAST(page_id AS VARCHAR) AS answer, CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'unknown' END AS category, 'p/' || page_id || '.png' AS image FROM pages
    """,
)
def annotations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions written as JSON lines, read in the order of the lines; answers stay text, some rows have no category."""
    pages, path = table(spark, sf_dir, "pages"), _folder(spark, "annotations")
    lines = pages.orderBy("page_id").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".png")).alias("file_name"), F.when(F.col("page_id") % 2 == 0, "even").alias("subset"), F.col("html").alias("question"), F.col("page_id").cast("string").alias("answer"))
    lines.write.json(path)
    return evaluation.with_aliases(readers.annotations(spark, path)).select("sample_index", "question", "answer", "category", "image")


@query(
    "image_tables_read",
    """
    WITH a AS (SELECT 0 AS nth, p_partkey AS k, 'a/' || p_partkey || '.jpg' AS image, p_name || ', "' || p_brand || '"' AS question, p_size AS img_width, p_size AS core_count FROM part WHERE p_size % 2 = 0
               UNION ALL SELECT 1, p_partkey, 'b/' || p_partkey || '.jpg', NULL, p_size, 0 FROM part WHERE p_size % 2 = 1)
    SELECT CAST(row_number() OVER (ORDER BY nth, k) - 1 AS VARCHAR) AS uid, image, question, CAST(img_width AS BIGINT) AS img_width, CAST(core_count AS BIGINT) AS core_count, CAST(0 AS BIGINT) AS fill_count FROM a
    """,
)
def image_tables_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two image tables of different columns as CSV, one under the other with uids and counts."""
    parts, path = table(spark, sf_dir, "part").orderBy("p_partkey"), _folder(spark, "images")
    name = lambda folder: F.concat(F.lit(folder), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("image")
    even = parts.where("p_size % 2 = 0").select(name("a/"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("question"), F.col("p_size").alias("img_width"), F.col("p_size").alias("core_count"))
    odd = parts.where("p_size % 2 = 1").select(F.col("p_size").alias("img_width"), name("b/"))
    for df, file in ((even, "a.csv"), (odd, "b.csv")):
        df.write.csv(f"{path}/{file}", header=True, escape='"')
    found = readers.image_tables(spark, [f"{path}/a.csv", f"{path}/b.csv"])
    return found.select("uid", "image", "question", F.col("img_width").cast("long").alias("img_width"), F.col("core_count").cast("long").alias("core_count"), F.col("fill_count").cast("long").alias("fill_count"))


@query(
    "records_read",
    "SELECT 'org/m' AS setting, 'd' AS dataset, CAST(page_id % 2 AS INTEGER) AS trial_id, html AS question, CAST(page_id AS VARCHAR) AS answer FROM pages",
)
def records_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of two trials, each written as one file and found by their paths."""
    pages, root = table(spark, sf_dir, "pages"), _folder(spark, "records")
    rows = pages.select(F.col("page_id").alias("sample_index"), (F.col("page_id") % 2).cast("int").alias("trial_id"), F.col("html").alias("question"), F.col("page_id").cast("string").alias("answer"))
    for t in (0, 1):
        writers.write_records(rows.where(F.col("trial_id") == t), writers.trial_folder(root, "org/m", "d", t))
    return readers.eval_records(spark, root).select("setting", "dataset", "trial_id", "question", "answer")


@query(
    "metrics_read",
    """
    WITH e AS (SELECT event_type AS category, CAST(event_id % 3 AS INTEGER) AS trial_id, CASE WHEN value > 40 THEN 'correct' ELSE 'wrong' END AS status FROM events),
    c AS (SELECT trial_id, coalesce(category, '__overall__') AS category, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) AS total FROM e GROUP BY GROUPING SETS ((trial_id, category), (trial_id)))
    SELECT 'm' AS setting, 'd' AS dataset, trial_id, category, correct / total AS accuracy FROM c
    """,
)
def metrics_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of three trials, each a document, read as rows by category."""
    events, root = table(spark, sf_dir, "events"), _folder(spark, "metrics")
    rows = events.select(F.col("event_type").alias("category"), (F.col("event_id") % 3).cast("int").alias("trial_id"), F.when(F.col("value") > 40, "correct").otherwise("wrong").alias("status"))
    documents = evaluation.metrics_document(evaluation.rollup(rows, "trial_id"), "trial_id")
    for t in range(3):
        writers.write_metrics(documents.where(F.col("trial_id") == t), writers.trial_folder(root, "m", "d", t))
    return readers.category_metrics(readers.trial_metrics(spark, root)).select("setting", "dataset", "trial_id", "category", "accuracy")


@query(
    "counts_read",
    "SELECT CAST(l_partkey AS VARCHAR) AS uid, count(*) FILTER (WHERE l_returnflag = 'A') AS core_count, count(*) FILTER (WHERE l_returnflag = 'N') AS alt_count, count(*) FILTER (WHERE l_returnflag = 'R') AS fill_count FROM lineitem GROUP BY l_partkey",
)
def counts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage counts after a round, found as the newest and read."""
    folder = _folder(spark, "counts")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("uid")).agg(*[F.count_if(F.col("l_returnflag") == f).alias(c) for f, c in zip("ANR", ("core_count", "alt_count", "fill_count"), strict=True)])
    writers.write_counts(rows, folder, 0)
    found = readers.counts(spark, readers.latest_counts(spark, folder))
    return found.select("uid", *[F.col(c).cast("long").alias(c) for c in ("core_count", "alt_count", "fill_count")])


@query(
    "summaries_read",
    """
    WITH t AS (SELECT 'm' || user_id % 3 AS setting, 'd' || event_id % 2 AS dataset, CAST(event_id // 2 % 3 AS INTEGER) AS trial_id, event_type AS category, value > 40 AS good FROM events),
    a AS (SELECT setting, dataset, trial_id, avg(CASE WHEN good THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM t GROUP BY ALL)
    SELECT setting, dataset, CAST(count(*) AS INTEGER) AS num_trials, round(avg(accuracy), 12) AS accuracy_mean, round(stddev_pop(accuracy), 12) AS accuracy_std FROM a GROUP BY setting, dataset
    """,
)
def summaries_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trials' metrics written and marked, summarised, the summaries written and read back; only settings all of whose trials are marked count."""
    root = _folder(spark, "summaries")
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("setting"), F.concat(F.lit("d"), (F.col("event_id") % 2).cast("string")).alias("dataset"), F.floor(F.col("event_id") / 2 % 3).cast("int").alias("trial_id"),
        F.col("event_type").alias("category"), F.when(F.col("value") > 40, "correct").otherwise("wrong").alias("status"),
    )
    keys = ("setting", "dataset", "trial_id")
    documents = staged(evaluation.metrics_document(evaluation.rollup(rows, *keys), *keys), "metrics")
    runs = [tuple(r) for r in documents.select(*keys).distinct().collect()]  # 18 at most
    for s, d, t in runs:
        folder = writers.trial_folder(root, s, d, t)
        writers.write_metrics(documents.where((F.col("setting") == s) & (F.col("dataset") == d) & (F.col("trial_id") == t)), folder)
        writers.mark_done(spark, folder)
    summary = staged(commands.summarise(spark, root), "summary")
    for s, d in sorted({r[:2] for r in runs}):
        done = {r["trial_id"] for r in readers.done_trials(spark, f"{root}/{s}/{d}").collect()}
        if done == {t for a, b, t in runs if (a, b) == (s, d)}:
            writers.write_summary(summary.where((F.col("setting") == s) & (F.col("dataset") == d)), f"{root}/{s}/{d}")
    found = readers.summaries(spark, root)
    return found.select("setting", "dataset", F.col("num_trials").cast("int").alias("num_trials"), F.round("accuracy_mean", 12).alias("accuracy_mean"), F.round("accuracy_std", 12).alias("accuracy_std"))


_ROLE = "CASE l_linenumber % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'alt' ELSE 'fill' END"


def _made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order stands for a collage, its lines for the layouts."""
    role = F.when(F.col("l_linenumber") % 3 == 0, "core").when(F.col("l_linenumber") % 3 == 1, "alt").otherwise("fill")
    layout = F.struct(F.col("l_linenumber").cast("int").alias("layout_id"), F.col("l_partkey").cast("string").alias("src_idx"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src_img"), role.alias("image_type"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("collage_index")).agg(F.collect_list(layout).alias("layouts"))
    shaped = collage.COLLAGE["layouts"].dataType.elementType
    have = {"layout_id", "src_idx", "src_img", "image_type"}
    whole = F.transform("layouts", lambda x: F.struct(*[(x[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in shaped.fields]))
    canvas = F.struct(*[(F.size("layouts") if f.name == "layout_count" else F.lit(None)).cast(f.dataType).alias(f.name) for f in collage.COLLAGE["canvas"].dataType.fields])
    return rows.select("collage_index", canvas.alias("canvas"), whole.alias("layouts"))


@query(
    "resume_read",
    f"""
    WITH u AS (SELECT l_partkey, count(*) FILTER (WHERE {_ROLE} = 'core') AS c, count(*) FILTER (WHERE {_ROLE} = 'alt') AS a, count(*) FILTER (WHERE {_ROLE} = 'fill') AS f FROM lineitem GROUP BY l_partkey)
    SELECT CAST(p_partkey AS VARCHAR) AS uid, coalesce(c, 0) AS core_count, coalesce(a, 0) AS alt_count, coalesce(f, 0) AS fill_count, (SELECT max(l_orderkey) + 1 FROM lineitem) AS next_index, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS produced
    FROM part LEFT JOIN u ON p_partkey = l_partkey
    """,
)
def resume_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's sidecars, counts and state written, and a run that goes on from them; its counts, and where it starts."""
    folder, made = _folder(spark, "run"), _made(spark, sf_dir)
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("uid"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("image"))
    produced = writers.write_sidecars(made, folder)
    resume.checkpoint(usage.add_usage(usage.default_counts(images), collage.used_in(made)), folder, 0, produced, resume.next_index(spark, folder))
    found, start = resume.prepare(images, folder)
    state = spark.read.schema("produced_total long, next_index long").json(f"{folder}/resume_state.json")
    counts = found.select("uid", *[F.col(c).cast("long").alias(c) for c in usage.COUNTS], F.lit(start).cast("long").alias("start"))
    return counts.join(F.broadcast(state), F.col("start") == F.col("next_index")).select("uid", *usage.COUNTS, "next_index", F.col("produced_total").alias("produced"))


@query(
    "sidecars_read",
    f"SELECT 'p' || l_partkey AS image, count(*) FILTER (WHERE {_ROLE} = 'core') AS core_count, count(*) FILTER (WHERE {_ROLE} = 'alt') AS alt_count, count(*) FILTER (WHERE {_ROLE} = 'fill') AS fill_count FROM lineitem GROUP BY l_partkey",
)
def sidecars_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars written by a run, scanned and counted by image."""
    folder = _folder(spark, "sidecars")
    writers.write_sidecars(_made(spark, sf_dir), folder)
    return usage.counts_from_layouts(readers.sidecars(spark, f"{folder}/layouts", lines=True))


@query(
    "final_counts_read",
    "SELECT CAST(p_partkey AS VARCHAR) AS uid, 'p/' || p_partkey AS image, CAST(p_size AS BIGINT) AS core_count, CAST(0 AS BIGINT) AS alt_count, CAST(p_partkey % 5 AS BIGINT) AS fill_count FROM part",
)
def final_counts_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final table preferred over a newer checkpoint, and read."""
    folder = _folder(spark, "final")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("uid"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("image"), F.col("p_size").alias("core_count"), F.lit(0).alias("alt_count"), (F.col("p_partkey") % 5).alias("fill_count"))
    writers.write_final_counts(rows, folder)
    writers.write_counts(rows.withColumn("core_count", F.lit(-1)), folder, 1)
    found = readers.counts(spark, readers.latest_counts(spark, folder))
    return found.select("uid", "image", *[F.col(c).cast("long").alias(c) for c in usage.COUNTS])


@query(
    "image_fallback",
    """
    WITH w AS (SELECT p_partkey, 'd.1/' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.gif' WHEN 1 THEN '.jpg' ELSE '' END AS image FROM part),
    l AS (SELECT 'd.1/' || p_partkey || CASE WHEN p_partkey % 4 = 0 THEN '.png' ELSE '.jpeg' END AS path FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT 'd.1/' || p_partkey || '.jpg' FROM part WHERE p_partkey % 7 = 0),
    t AS (SELECT p_partkey, image, unnest([image] || ['d.1/' || p_partkey || e FOR e IN ['.jpg', '.jpeg', '.png', '.bmp', '.tiff']]) AS tried, unnest(range(6)) AS nth FROM w),
    f AS (SELECT p_partkey, arg_min(tried, nth) AS found FROM t JOIN (SELECT DISTINCT path FROM l) ON path = tried GROUP BY p_partkey)
    SELECT p_partkey, image, found FROM w LEFT JOIN f USING (p_partkey)
    """,
)
def image_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's path, or the first with another usual extension that is in the listing."""
    name = F.concat(F.lit("d.1/"), F.col("p_partkey").cast("string"))
    parts, kind, other = table(spark, sf_dir, "part"), F.col("p_size") % 3, F.col("p_partkey") % 4 == 0
    wanted = parts.select("p_partkey", F.concat(name, F.when(kind == 0, ".gif").when(kind == 1, ".jpg").otherwise("")).alias("image"))
    listing = parts.where("p_partkey % 5 > 0").select(F.concat(name, F.when(other, ".png").otherwise(".jpeg")).alias("path")).unionByName(parts.where("p_partkey % 7 = 0").select(F.concat(name, F.lit(".jpg")).alias("path")))
    return readers.resolved_images(wanted, listing).select("p_partkey", "image", "found")


@query(
    "training_read",
    "SELECT lang AS data_source, text AS question, CAST(doc_id AS VARCHAR) AS ground_truth, CAST(doc_id AS DOUBLE) AS x1 FROM documents",
)
def training_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of several sources, each in files of its own, read as one."""
    docs, folder = table(spark, sf_dir, "documents"), _folder(spark, "training")
    have = {
        "data_source": F.col("lang"), "prompt": F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))), "reward_model": F.struct(F.col("doc_id").cast("string").alias("ground_truth"), F.lit("rule").alias("style")),
        "extra_info": F.struct(F.array(F.array(F.lit(0.0), F.lit(0.0), F.col("doc_id").cast("double"), F.lit(1.0))).alias("bboxes")),
    }
    rows = docs.select(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.TRAINING.fields])
    sources = (("en", F.col("data_source") == "en"), ("other", ~F.col("data_source").eqNullSafe("en")))
    for name, own in sources:
        rows.where(own).write.parquet(f"{folder}/{name}")
    found = readers.training_rows(spark, [f"{folder}/{name}" for name, _ in sources])
    return found.select("data_source", F.get("prompt", F.lit(0))["content"].alias("question"), "reward_model.ground_truth", F.get(F.get("extra_info.bboxes", F.lit(0)), F.lit(2)).alias("x1"))


@query("records_order", "SELECT row_number() OVER (ORDER BY page_id) - 1 AS sample_index, CAST(page_id AS VARCHAR) AS answer, length(html) AS size FROM pages")
def records_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that come in any order, written in that of the questions and read line by line."""
    folder = writers.trial_folder(_folder(spark, "order"), "m", "d", 0)
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("sample_index"), F.lit(0).alias("trial_id"), F.col("html").alias("question"), F.col("page_id").cast("string").alias("answer"))
    writers.write_records(rows.repartition(7, "answer"), folder)
    found = readers.annotations(spark, f"{folder}/eval_records.jsonl")
    return found.select("sample_index", "answer", F.char_length("question").cast("long").alias("size"))
