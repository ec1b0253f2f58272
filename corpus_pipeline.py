"""From raw documents to token ids: five stages, each written as Parquet and read again.

Every stage takes all that the one before it kept, and its decisions take
effect.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontamination, line_dedup, quadratic, simhash
from tessella.llm.support import discard, staged_alone, table

#: The tokenizer's file; a parameter of the last stage.
TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant scores 0.5 or more; each row is scored on its own text, a null one as empty, whether its id is null or repeats."""
    model = quadratic.fit(docs, table(spark, sf_dir, "labels"))
    return quadratic.score(docs, model).where(F.col("score") >= 0.5).select("row.*")


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that three or more share, but for the last holder's; ``n_chars`` follows the text, a null text stays null."""
    cut = line_dedup.drop_shared_lines(docs)
    shorter = F.col("n_dropped") > 0
    new = {"text": F.when(shorter, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(shorter, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; each row is looked up by its own text, and a null one has no words, so it stays."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with digests of them and of their decoding; one row for each row, a null text has no ids."""
    import public_tokenizers

    rows = bpe.encode_texts(docs, bpe.load_vocabulary(public_tokenizers.path(TOKENIZER)))
    return rows.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("line_dedup", shared_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("bpe", encoded),
]

#: SQL can't express the discriminant, the fingerprints or BPE; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        docs = staged_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # the tables that this made, never the input
    return docs
