"""Queries on outcomes, answers, prompts and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chat, text
from ..operators import evaluation, inference, relational
from ..sources.readers import table
from .registry import query


@query(
    "status_rollup",
    """
    WITH s AS (SELECT coalesce(lang, 'unknown') AS category, CASE WHEN l.doc_id IS NULL THEN 'incomplete' WHEN quality = 1 AND toxic = 1 THEN 'invalid' WHEN quality = 1 THEN 'correct' ELSE 'wrong' END AS status
               FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    c AS (SELECT coalesce(category, '__overall__') AS category, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'wrong') AS wrong,
                 count(*) FILTER (WHERE status = 'incomplete') AS incomplete, count(*) FILTER (WHERE status = 'invalid') AS invalid, count(*) AS total FROM s GROUP BY ROLLUP (category))
    SELECT *, (correct + wrong) / total AS success_rate, coalesce((correct + wrong) / nullif(correct + wrong + incomplete, 0), 0) AS completion_rate, correct / total AS accuracy FROM c
    """,
)
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes by language (the subset) and overall; a label stands for an evaluation."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = evaluation.with_aliases(docs.select("doc_id", F.col("lang").alias("subset"))).select("doc_id", "category").join(labels, "doc_id", "left")
    seen, good, bad = F.col("quality").isNotNull(), F.col("quality") == 1, F.col("toxic") == 1
    outcome = evaluation.status(seen & ~(good & bad), good, F.lit(True), F.when(seen, "stop").otherwise("length"))
    return evaluation.rollup(joined.withColumn("status", outcome))


_TRIALS = """
    WITH e AS (SELECT event_type AS category, CAST(event_id % 3 AS INTEGER) AS trial_id, CASE WHEN value IS NULL THEN 'invalid' WHEN user_id % 7 = 0 THEN 'incomplete' WHEN value > 40 THEN 'correct' ELSE 'wrong' END AS status FROM events),
    c AS (SELECT trial_id, coalesce(category, '__overall__') AS category, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'wrong') AS wrong,
                 count(*) FILTER (WHERE status = 'incomplete') AS incomplete, count(*) AS total FROM e GROUP BY GROUPING SETS ((trial_id, category), (trial_id))),
    r AS (SELECT *, (correct + wrong) / total AS success_rate, coalesce((correct + wrong) / nullif(correct + wrong + incomplete, 0), 0) AS completion_rate, correct / total AS accuracy FROM c)
"""


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value").isNull(), "invalid").when(F.col("user_id") % 7 == 0, "incomplete").when(F.col("value") > 40, "correct").otherwise("wrong")
    events = table(spark, sf_dir, "events").select("user_id", "value", F.col("event_type").alias("category"), (F.col("event_id") % 3).cast("int").alias("trial_id"))
    return evaluation.rollup(events.withColumn("status", status), "trial_id")


@query(
    "trial_summary",
    _TRIALS
    + """
    SELECT category, count(DISTINCT trial_id) AS num_trials, round(avg(success_rate), 10) AS success_rate_mean, round(stddev_pop(success_rate), 10) AS success_rate_std, round(avg(completion_rate), 10) AS completion_rate_mean,
           round(stddev_pop(completion_rate), 10) AS completion_rate_std, round(avg(accuracy), 10) AS accuracy_mean, round(stddev_pop(accuracy), 10) AS accuracy_std FROM r GROUP BY category
    """,
)
def trial_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, D3: means and population deviations over three trials, by category and overall."""
    out = evaluation.over_trials(_trials(spark, sf_dir), "category")
    return out.select("category", "num_trials", *[F.round(c, 10).alias(c) for c in out.columns if c.endswith(("_mean", "_std"))])


@query(
    "rate_shortfalls",
    _TRIALS
    + """
    SELECT category, round(avg(success_rate), 10) AS success_rate_mean, round(avg(completion_rate), 10) AS completion_rate_mean FROM r GROUP BY category HAVING avg(success_rate) < 1 OR avg(completion_rate) < 1
    """,
)
def rate_shortfalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories whose success or completion is below 1."""
    low = evaluation.shortfalls(evaluation.over_trials(_trials(spark, sf_dir), "category"))
    return low.select("category", F.round("success_rate_mean", 10).alias("success_rate_mean"), F.round("completion_rate_mean", 10).alias("completion_rate_mean"))


@query(
    "metrics_document",
    _TRIALS
    + """
    SELECT trial_id, max(accuracy) FILTER (WHERE category = '__overall__') AS overall_accuracy, max(correct) FILTER (WHERE category = '__overall__') AS overall_correct,
           max(accuracy) FILTER (WHERE category = 'click') AS click_accuracy, count(*) FILTER (WHERE category <> '__overall__') AS categories FROM r GROUP BY trial_id
    """,
)
def metrics_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, H2: one document of rates and counts a trial, with categories as map keys; some of it shown."""
    doc = evaluation.metrics_document(_trials(spark, sf_dir), "trial_id")
    return doc.select(
        "trial_id", "overall_accuracy", F.col("overall_stats")["correct"].alias("overall_correct"), F.col("category_accuracy")["click"].alias("click_accuracy"), F.size("category_stats").cast("long").alias("categories")
    )


_CELLS = ["0", "1", "2", "3", "4"]


@query(
    "gather_pivot",
    """
    WITH e AS (SELECT event_type AS setting, CAST(user_id % 5 AS VARCHAR) AS dataset, CAST(event_id % 3 AS INTEGER) AS trial_id, avg(CASE WHEN value > 40 THEN 1.0 ELSE 0.0 END) AS accuracy
               FROM events WHERE NOT (event_type = 'click' AND user_id % 5 = 2) GROUP BY ALL),
    s AS (SELECT setting, dataset, avg(accuracy) AS m, stddev_pop(accuracy) AS sd, count(DISTINCT trial_id) AS n FROM e GROUP BY setting, dataset),
    g AS (SELECT DISTINCT event_type AS setting FROM events),
    c AS (SELECT setting, dataset, printf('%.1f±%.1f @%d', round_even(m * 100, 1), round_even(sd * 100, 1), n) AS cell FROM s)
    SELECT g.setting, """
    + ", ".join(f"coalesce(max(cell) FILTER (WHERE dataset = '{d}'), 'N/A') AS \"{d}\"" for d in _CELLS)
    + " FROM g LEFT JOIN c ON g.setting = c.setting GROUP BY g.setting",
)
def gather_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings by datasets, with a cell that has no results."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("setting"), (F.col("user_id") % 5).cast("string").alias("dataset"), (F.col("event_id") % 3).alias("trial_id"), "value")
    seen = events.where(~((F.col("setting") == "click") & (F.col("dataset") == "2")))
    accuracy = seen.groupBy("setting", "dataset", "trial_id").agg(F.avg(F.when(F.col("value") > 40, 1.0).otherwise(0.0)).alias("accuracy"))
    summaries = evaluation.over_trials(accuracy, "setting", "dataset", values=("accuracy",))
    datasets = spark.createDataFrame([(d,) for d in _CELLS], "dataset string")
    grid = events.select("setting").distinct().crossJoin(F.broadcast(datasets))  # settings asked for, by five names
    return evaluation.matrix(grid, summaries, _CELLS)


@query(
    "answer_extract_last",
    r"""
    WITH a AS (SELECT page_id, replace(replace(html, '<li>', '<answer>'), '</li>', '</answer>') AS c FROM pages),
    b AS (SELECT page_id, c, regexp_extract_all(c, '<answer>(.*?)</answer>', 1, 's') AS m FROM a),
    t AS (SELECT page_id, CASE WHEN len(m) > 0 THEN regexp_replace(regexp_replace(m[-1], '^\s+', ''), '\s+$', '') ELSE c END AS tagged FROM b)
    SELECT page_id, tagged AS answer, regexp_matches(tagged, '\\boxed\{.*?\}', 's') AS boxed FROM t
    """,
)
def answer_extract_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last tagged answer of a response; list items stand for answers."""
    pages = table(spark, sf_dir, "pages")
    response = F.replace(F.replace("html", F.lit("<li>"), F.lit("<answer>")), F.lit("</li>"), F.lit("</answer>"))
    answer = text.rule_answer(response)
    return pages.select("page_id", answer.alias("answer"), answer.rlike(text.BOXED).alias("boxed"))


@query(
    "boxed_answer",
    r"""
    WITH a AS (SELECT conv_id, turn, '<answer>first \boxed{' || role || '} or \boxed{ ' || text || ' }</answer>' AS c FROM conversations),
    t AS (SELECT conv_id, turn, trim(regexp_extract_all(c, '<answer>(.*?)</answer>', 1, 's')[-1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS tagged FROM a)
    SELECT conv_id, turn, trim(regexp_extract_all(tagged, '\\boxed\{(.*?)\}', 1, 's')[-1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS answer FROM t
    """,
)
def boxed_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the last boxed part of the tagged answer, which holds the whole text."""
    c = F.concat(F.lit(r"<answer>first \boxed{"), F.col("role"), F.lit(r"} or \boxed{ "), F.col("text"), F.lit(" }</answer>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.rule_answer(c).alias("answer"))


@query(
    "strip_and_match",
    r"""
    SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS stripped, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') = text AS same,
           contains(lower(text), 'correct') OR contains(lower(text), 'th') AS verdict FROM conversations
    """,
)
def strip_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """white space off, verbatim equality, and a reply's verdict."""
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.strip(c).alias("stripped"), (text.strip(c) == c).alias("same"), (text.verdict(c) | F.contains(F.lower(c), F.lit("th"))).alias("verdict"))


@query("left_crop", "SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN '[cropped] ... ' || right(text, 200) ELSE text END AS cropped FROM conversations")
def left_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the end of a long response."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.left_crop(F.col("text"), 200).alias("cropped"))


@query(
    "verdict_contains",
    "SELECT conv_id, turn, contains(lower('<' || CASE turn % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'wrong' ELSE 'Incorrect' END || '>'), 'correct') AS loose, turn % 3 = 0 AS strict FROM conversations",
)
def verdict_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loose reading takes "incorrect" for correct, the strict one doesn't."""
    reply = F.concat(F.lit("<"), F.when(F.col("turn") % 3 == 0, "correct").when(F.col("turn") % 3 == 1, "wrong").otherwise("Incorrect"), F.lit(">"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.verdict(reply).alias("loose"), text.verdict(reply, strict=True).alias("strict"))


@query(
    "prompt_build",
    """
    SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE text || chr(10) || 'A. ' || role || chr(10) || 'B. other' END AS prompt, turn % 2 = 1 AS has_options,
           'Q: ' || text || chr(10) || 'O: ' || CASE WHEN turn % 2 = 1 THEN 'A. ' || role || chr(10) || 'B. other' ELSE '' END AS filled FROM conversations
    """,
)
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question with or without options, and a filled template."""
    options = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("A. "), F.col("role"), F.lit("\nB. other")))
    filled = text.filled("Q: {question}\nO: {options}", question=F.col("text"), options=options)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.prompt(F.col("text"), options).alias("prompt"), text.has_options(options).alias("has_options"), filled.alias("filled"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.when(F.col("turn") % 2 == 0, chat.query_message(F.col("text"), F.lit("http://x/i.jpg"))).otherwise(chat.message(F.col("role"), text=F.col("text")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", parts.alias("m"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "m"))), lambda x: x["m"]).alias("messages"))


@query(
    "message_format",
    """
    SELECT conv_id, string_agg('[' || CASE WHEN turn % 2 = 0 THEN 'USER' ELSE upper(role) END || ']' || chr(10) || CASE WHEN turn % 2 = 0 THEN '<image>' ELSE '' END || text || chr(10), '' ORDER BY turn) FILTER (WHERE turn % 2 = 0 OR upper(role) <> 'SYSTEM') AS transcript
    FROM conversations GROUP BY conv_id
    """,
)
def message_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as text, images left out."""
    return _messages(spark, sf_dir).select("conv_id", chat.formatted(F.col("messages")).alias("transcript"))


@query(
    "message_prune",
    """
    SELECT conv_id, string_agg('[' || CASE WHEN turn % 2 = 0 THEN 'USER' ELSE upper(role) END || ']' || chr(10) || CASE WHEN turn % 2 = 0 THEN '<image>' ELSE '' END || text || chr(10), '' ORDER BY turn) AS transcript,
           count(*) FILTER (WHERE turn % 2 = 0) AS pruned FROM conversations GROUP BY conv_id
    """,
)
def message_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts other than text hold a mark in place of their data, and are shown as what they are."""
    kept = F.transform("messages", chat.pruned)
    marks = F.size(F.filter(F.flatten(F.transform(kept, lambda m: F.coalesce(m["content_parts"], F.array()))), lambda p: p["image_url"]["url"] == chat.PRUNED)).cast("long")
    return _messages(spark, sf_dir).select("conv_id", chat.formatted(kept, omit_system_prompt=False).alias("transcript"), marks.alias("pruned"))


@query(
    "first_success",
    """
    SELECT user_id, coalesce(arg_min(value, event_id) FILTER (WHERE event_type = 'purchase'), NULL) AS first_value, count(*) AS results FROM events GROUP BY user_id
    """,
)
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first success; events stand for results."""
    return evaluation.first_success_by(table(spark, sf_dir, "events"), "user_id", "value", "event_id", F.col("event_type") == "purchase")


@query(
    "strict_zip",
    "SELECT vec_id, count(*) AS pairs, CAST(sum(i * CAST(round(CAST(embedding[i] AS DOUBLE) * 1000) AS BIGINT)) AS BIGINT) AS weighted, min(i) FILTER (WHERE embedding[i] > 0) AS first_positive FROM embeddings, range(1, 65) t(i) GROUP BY vec_id",
)
def strict_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and values paired by position, which must be as many; the first pair that succeeded."""
    pairs = evaluation.zipped(F.sequence(F.lit(1), F.lit(64)).alias("i"), F.col("embedding"))
    results = F.transform(pairs, lambda p: F.struct(p["i"].cast("long").alias("i"), (p["embedding"] > 0).alias("success"), F.rint(p["embedding"].cast("double") * 1000).cast("long").alias("value")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", results.alias("results"))
    weighted = F.aggregate("results", F.lit(0).cast("long"), lambda a, r: a + r["i"] * r["value"])
    return rows.select("vec_id", F.size("results").cast("long").alias("pairs"), weighted.alias("weighted"), evaluation.first_success(F.col("results"))["i"].alias("first_positive"))


@query(
    "set_difference",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
)
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is planned less what is done."""
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return evaluation.trials_to_run(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query(
    "chat_eval_fake",
    """
    WITH s AS (SELECT conv_id * 10 + turn AS sample_index, role AS category, turn % 2 = 1 AS mcq, CASE WHEN turn % 2 = 1 THEN 'A' ELSE 'gt' || conv_id % 5 END AS answer, conv_id FROM conversations WHERE conv_id IS NOT NULL),
    r AS (SELECT *, sample_index % 11 = 0 AS failed, sample_index % 7 = 0 AS cut, CASE WHEN mcq THEN CASE sample_index % 3 WHEN 0 THEN 'A' ELSE 'B' END ELSE 'gt' || sample_index % 5 END AS said FROM s),
    o AS (SELECT category, CASE WHEN failed THEN 'invalid' WHEN cut THEN 'incomplete' WHEN said = answer THEN 'correct' WHEN mcq THEN 'wrong' WHEN length(said) = length(answer) AND sample_index % 4 = 0 THEN 'correct' ELSE 'wrong' END AS status FROM r)
    SELECT coalesce(category, '__overall__') AS category, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'wrong') AS wrong, count(*) FILTER (WHERE status = 'incomplete') AS incomplete,
           count(*) FILTER (WHERE status = 'invalid') AS invalid, count(*) AS total FROM o GROUP BY ROLLUP (category)
    """,
)
def chat_eval_fake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation with a deterministic model: inference, rules, judge for the rest, classification, counts."""
    rows = table(spark, sf_dir, "conversations").where(F.col("conv_id").isNotNull())
    samples = rows.select(
        (F.col("conv_id") * 10 + F.col("turn")).alias("sample_index"),
        F.col("role").alias("category"),
        F.lit("i.jpg").alias("image"),
        F.col("text").alias("question"),
        F.when(F.col("turn") % 2 == 1, "A. yes\nB. no").alias("options"),
        F.when(F.col("turn") % 2 == 1, "A").otherwise(F.concat(F.lit("gt"), (F.col("conv_id") % 5).cast("string"))).alias("answer"),
    )
    records = inference.evaluate(samples, inference.ArithmeticBackend(), inference.ArithmeticJudge(), trials=[0])
    counted = evaluation.rollup(records.withColumn("status", evaluation.record_status(F.col("eval_result"))))
    return counted.select("category", *evaluation.OUTCOMES, "total")


@query(
    "union_by_name",
    "SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_nationkey, s_acctbal, NULL FROM supplier",
)
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with different columns, one under the other."""
    wanted = ["name", "nation", "balance", "segment"]
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), "s_suppkey")
    return relational.union_all([relational.pruned(df, wanted) for df in (customers, suppliers)]).select(*wanted)


@query("latest_by", "SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id")
def latest_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user, the latest event."""
    return relational.latest(table(spark, sf_dir, "events"), "event_type", "ts", "user_id")


@query(
    "model_flags",
    "SELECT p_partkey, contains(lower(p_type), 'brass') AS is_brass, CASE p_size % 3 WHEN 0 THEN 'ann/a.jsonl' WHEN 1 THEN 'ann/b.jsonl' END AS ann_file, upper(substr(p_brand, 1, 1)) || lower(substr(p_brand, 2)) AS brand FROM part",
)
def model_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name tests, a dictionary lookup and capitals."""
    parts = relational.lookup(table(spark, sf_dir, "part").withColumn("k", (F.col("p_size") % 3).cast("string")), "k", {"0": "ann/a.jsonl", "1": "ann/b.jsonl"}, "ann_file")
    return parts.select("p_partkey", text.matches_glob(F.lower("p_type"), "brass").alias("is_brass"), "ann_file", text.capitalised(F.col("p_brand")).alias("brand"))


@query(
    "path_functions",
    r"""
    SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, CASE WHEN url LIKE '/%' THEN url ELSE '/data/' || url END AS joined,
           CASE WHEN page_id % 2 = 0 THEN page_id END AS stem_number, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+(\.[^.]*)$', 1)) AS ext FROM pages
    """,
)
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths joined and taken apart."""
    name = F.concat(F.lit("images/0/"), F.when(F.col("page_id") % 2 == 0, F.col("page_id").cast("string")).otherwise("x1"), F.lit(".jpg"))
    return table(spark, sf_dir, "pages").select("page_id", text.basename(F.col("url")).alias("base"), text.joined_path(F.lit("/data/"), F.col("url")).alias("joined"), text.integer_stem(name).alias("stem_number"), text.extension(F.col("url")).alias("ext"))


@query(
    "data_url_roundtrip",
    "SELECT conv_id, turn, text AS back, base64(encode(text)) AS sent, CAST(NULL AS BLOB) IS NULL AS other_is_null FROM conversations",
)
def data_url_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to a data URL and back; other URLs have no bytes."""
    url = text.data_url(F.encode("text", "utf-8"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.decode(text.data_url_bytes(url), "utf-8").alias("back"), F.substring_index(url, "base64,", -1).alias("sent"), text.data_url_bytes(F.lit("http://x")).isNull().alias("other_is_null")
    )


@query(
    "json_props",
    "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS doc FROM events",
)
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: JSON read and written."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


@query(
    "layout_targets",
    """
    SELECT vec_id, CAST(i AS INTEGER) AS layout_id, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS x0, list_contains([label % 3, 2], i) AS is_target FROM embeddings, range(0, 3) t(i)
    """,
)
def layout_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts held in a map, exploded, with whether each is a target."""
    box = lambda i: F.struct(F.array(*[F.round(F.get("embedding", F.lit(i)).cast("double"), 6)] * 4).alias("bbox"))
    infos = F.create_map(*[x for i in range(3) for x in (F.lit(str(i)), box(i))])
    targets = F.array((F.col("label") % 3).cast("int"), F.lit(2))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(relational.target_layouts(infos, targets)).alias("x"))
    return rows.select("vec_id", F.col("x.layout_id").alias("layout_id"), F.get("x.bbox", F.lit(0)).alias("x0"), "x.is_target")


@query("every_tenth", "SELECT event_id, user_id FROM events WHERE event_id % 10 = 0")
def every_tenth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are displayed."""
    return relational.every_nth(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")


@query(
    "transcript_frames",
    """
    SELECT conv_id, turn, '>>>>>>>>>>>>>>>>>>> ' || role || ' messages start >>>>>>>>>>>>>>>>>>>' || chr(10) || text || '<<<<<<<<<<<<<<<<<<< ' || role || ' messages stop <<<<<<<<<<<<<<<<<<<<' || chr(10) AS framed FROM conversations
    """,
)
def transcript_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transcripts between their start and stop lines."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", chat.framed(F.col("role"), F.col("text")).alias("framed"))


@query(
    "wrapped_lines",
    """
    WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g') AS t FROM documents)
    SELECT doc_id, length(t) > 0 AS some, regexp_replace(t, '[ ]+', '', 'g') AS words FROM d
    """,
)
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts broken into lines; all words are there, in order, and no line that has a space is too long (a null otherwise)."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "?")
    rows = table(spark, sf_dir, "documents").select("doc_id", plain.alias("t"), text.wrapped(plain, 60).alias("w"))
    lines = F.split("w", "\n")
    fits = F.forall(lines, lambda x: (F.char_length(x) <= 60) | ~F.contains(F.trim(x), F.lit(" ")))
    words = F.when(text.strip(F.col("t")) == "", F.replace("t", F.lit(" "), F.lit(""))).otherwise(F.regexp_replace("w", "[ \n]+", ""))
    return rows.select("doc_id", (F.char_length("t") > 0).alias("some"), F.when(fits, words).alias("words"))
