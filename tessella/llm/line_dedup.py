"""Line dedup: drop lines that many documents share, keeping one holder.

Native: every step is a DataFrame expression.  Lines are exploded once into
fixed-width rows (document, position, 128 bits of the key's SHA-256) that are staged; the
distinct-document counts are partial aggregates, and the few keys that hold a
large share of all rows are broadcast to them, so a line that a third of all
documents share never meets in one task; the text itself moves once, when the
positions to drop are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .support import discard, hashed, staged, table

#: The white space that is stripped from a line, and the letters that are lower-cased.
STRIPPED = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bound on the keys that are broadcast because they are too frequent to be dealt out by.
HOT_KEYS = 2_000


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, UPPER.lower())


def line_hash(key: Column) -> Column:
    """Half of the SHA-256, so that not even crafted lines are taken for each other."""
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


def drop_shared_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
) -> DataFrame:
    """Drop every line whose key is held by ``min_docs`` documents or more,
    except in the largest ``id_col`` that holds it.

    Returns ``row`` (a struct of all columns of ``docs``), ``n_lines``,
    ``n_dropped`` and ``kept`` (the text left).  Columns of ``docs`` may have
    any names; they travel inside ``row``.

    Defined cases: a null or empty text is one empty line, which stays (its key
    is short).  Rows that repeat an id count as one document; each is cleaned on
    its own text.  A row whose id is null counts for no line and loses none.  An
    empty table gives an empty result.
    """
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    lines = base.where(F.col("id").isNotNull()).select("id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    keyed = staged(keyed.select("id", "text_hash", "pos", line_hash(F.col("key")).alias("hash")), "lines")
    counts = [F.count_distinct("id").alias("holders"), F.max("id").alias("keeper"), F.count(F.lit(1)).alias("rows")]
    shared = staged(keyed.groupBy("hash").agg(*counts).where(F.col("holders") >= min_docs), "shared")
    # keys with more than 1/HOT_KEYS of all rows: HOT_KEYS at most, as their rows add up to all, so they may be broadcast
    hot = F.col("rows") > max(1000, keyed.count() // HOT_KEYS)
    often = F.broadcast(shared.where(hot).select("hash", "keeper"))
    seldom = shared.where(~hot).select("hash", "keeper")
    held = keyed.join(often, "hash").unionByName(keyed.join(often, "hash", "left_anti").join(seldom, "hash"))
    drops = held.where(F.col("id") < F.col("keeper")).groupBy("id", "text_hash").agg(F.collect_set("pos").alias("dropped"))
    drops = staged(drops, "drops")
    rows, places = drops.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("dropped")), F.lit(0))).first()
    discard(keyed, shared)
    cut = base.join(hashed(drops, 64 * rows + 4 * places), ["id", "text_hash"], "left").select("row", "text", F.split("text", "\n", -1).alias("lines"), "dropped")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n")
    return cut.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of lines, of dropped lines and the digest of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_shared_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(k.doc_id < f.keeper, false) AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
