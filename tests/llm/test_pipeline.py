"""The pipeline against its stages done by hand."""

import zlib

import pytest

import corpus_pipeline
from tessella.llm import bpe, quadratic

from .test_decontamination import brute as brute_leaks
from .test_native import brute_lines
from .test_simhash import brute_groups

LABELS = "doc_id long, quality int, toxic int"


def test_stages_equal_brute_force(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    import random

    from .fixtures import SCHEMA, documents, labels, prose

    rows = [r for r in documents(8, 60) if r[0] is not None and len(r[1] or "") < 20_000]
    rows = list({r[0]: r for r in rows}.values())
    r = random.Random(1)
    items = [(i, prose(r, 14)) for i in range(3)]
    rows += [(300 + i, prose(r, 30) + " " + items[i][1] + " " + prose(r, 9), "en", "s", 1) for i in range(3)]
    rows += [(400 + i, " ".join(w.upper() + "!!" for w in prose(r, 40).split()), "en", "s", 1) for i in range(30)]
    marks = labels(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = quadratic.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    good = {x["row"]["doc_id"] for x in quadratic.score(docs, model).where("score >= 0.5").collect()}
    now = [x for x in rows if x[0] in good]
    assert len(now) < len(rows) and sum(zlib.crc32(str(x[0]).encode()) % 3 == 1 for x in now)
    cut = {x[0]: x for x in brute_lines(now)}
    now = [(x[0], cut[x[0]][3] if cut[x[0]][2] else x[1], *x[2:]) for x in now]
    kept = {eval(g)[2] for g in brute_groups(now)}
    now = [x for x in now if x[0] in kept]
    leaks = {eval(x)[0] for x in brute_leaks(now, items) if eval(x)[2]}
    assert leaks
    now = [x for x in now if x[0] not in leaks]
    want = sorted((x[0], library.encode(x[1] or "", add_special_tokens=False).ids) for x in now)

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = lambda b: [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]
    assert sorted((x["doc_id"], ids(bytes(x["ids"]))) for x in got) == want


@pytest.mark.parametrize("rows", ["none", "hard"])
def test_hard_tables_go_through(spark, tmp_path, rows):
    """No documents, labels or items at all; then nulls, repeats, ties and empty and long texts, without any label."""
    pytest.importorskip("public_tokenizers")
    from .fixtures import SCHEMA, documents

    docs = documents(3, 20) if rows == "hard" else []
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, "alpha " * 12), (1, None), (1, "")] if docs else [], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # without labels the score is one half, so all documents stay; one of each group of equal texts remains
    assert (len(got) > 10 and {r["doc_id"] for r in got} <= {r[0] for r in docs}) if docs else not got


def test_a_run_leaves_its_result_alone_behind(spark, sf_dir):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(glob.glob(f"{folder}/tessella/*"))
    corpus_pipeline.run(spark, sf_dir)
    left = set(glob.glob(f"{folder}/tessella/*")) - before
    assert len(left) == 1 and "pipeline-bpe" in left.pop()


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_vocabulary_is_read_from_its_path():
    assert bpe.byte_letters()[0x20] == "Ġ"
