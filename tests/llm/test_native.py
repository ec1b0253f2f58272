"""Line dedup and quotation links, against plain Python and SQL."""

import hashlib
import random
import re
import time

import duckdb
import pytest

from tessella.llm import line_dedup, quotations, queries

from ..conftest import rows_of
from .fixtures import clashing, documents, prose, table_of


def brute_lines(rows, min_chars=20, min_docs=3):
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    holders = {}
    for r in rows:
        if r[0] is not None:
            for line in (r[1] or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders.setdefault(key(line), set()).add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        gone = [r[0] is not None and len(holders.get(key(x), ())) >= min_docs and r[0] < max(holders[key(x)]) for x in lines]
        out.append((r[0], len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_line_dedup_equals_brute_force(spark, seed):
    rows = documents(seed)
    got = line_dedup.drop_shared_lines(clashing(table_of(spark, rows))).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute_lines(rows)))
    assert sum(r["n_dropped"] for r in got) > 5


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_shared_lines(table_of(spark, documents()).limit(0)).count() == 0


def test_line_dedup_runs_without_python(spark):
    df = line_dedup.drop_shared_lines(table_of(spark, documents()))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in range(30):
        own = []
        for t in range(r.randint(1, 8)):
            paras = [prose(r, r.randint(1, 8)) + str(r.randint(0, 30)) for _ in range(r.randint(1, 3))]
            lines = []
            if own and r.random() < 0.8:
                q = r.choice(r.choice(own))
                if r.random() < 0.5:
                    lines.append(r.choice(["On Monday, X wrote:", "Anna schrieb:", "He wrote:"]))
                if r.random() < 0.2:
                    lines.append("")
                words = q.split(" ")
                lines += ["> " + " ".join(words[:2]), "> " + " ".join(words[2:])] if r.random() < 0.3 and len(words) > 3 else [r.choice(["> ", ">", " > "]) + q.upper()]
                if r.random() < 0.4:
                    lines.append(">> " + r.choice(r.choice(own)))
            elif r.random() < 0.2 and rows:
                lines.append("> " + (rows[-1][3] or "x").split("\n")[-1])
            own.append(paras)
            rows.append((c, t, "user", "\n".join(lines + paras)))
    return [*rows, (3, 0, "user", rows[0][3]), (None, 1, "user", "> " + prose(r, 4)), (5, None, "user", None), (6, 50, "system", "")]


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_quotations_equal_sql(spark, tmp_path, seed):
    df = spark.createDataFrame(conversations(seed), CONVERSATIONS)
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op1_quote_links"](spark, str(tmp_path)).toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert rows_of(got) == rows_of(db.execute(queries.ORACLES["op1_quote_links"]).df())
    assert got["reply_to"].notna().sum() > 20 and got["source_conv"].notna().sum() > 0


def test_a_thread_reads_in_reply_order(spark):
    rows = [
        (1, 0, "user", "the first message here"),
        (1, 1, "user", "another thread begins now"),
        (1, 2, "assistant", "He wrote:\n> the first message here\nan answer to the first one"),
        (1, 3, "user", "> an answer to the first one\n>> the first message here\n\nthanks for that answer"),
        (2, 0, "user", "> another   THREAD begins now\nseen elsewhere"),
    ]
    got = {(r["row"]["conv_id"], r["row"]["turn"]): r for r in quotations.link_quotations(clashing(spark.createDataFrame(rows, CONVERSATIONS))).collect()}
    assert [(got[1, t]["reply_to"], got[1, t]["thread"], got[1, t]["depth"]) for t in range(4)] == [(None, 0, 0), (None, 1, 0), (0, 0, 1), (2, 0, 2)]
    assert [got[1, t]["body"] for t in (2, 3)] == ["an answer to the first one", "thanks for that answer"]
    assert got[1, 3]["max_level"] == 2 and got[1, 3]["n_quoted"] == 2
    assert (got[2, 0]["source_conv"], got[2, 0]["source_turn"], got[2, 0]["body"]) == (1, 1, "seen elsewhere")


def test_branches_are_whole_and_short_quotations_link(spark):
    rows = [
        (1, 0, "user", "shall we meet on Monday"),
        (1, 1, "a", "> shall we meet on Monday\nYes."),
        (1, 2, "b", "> shall we meet on Monday\nNo."),
        (1, 3, "c", "> Yes.\nGood, at ten then"),
        (1, 4, "user", "something else"),
        (1, 5, "a", "> No.\n>\n> shall we meet\n> on Monday\nWhy not?"),
        (1, 6, "b", "> Good, at ten then\nfine"),
        (2, 0, "user", "> Yes.\ntoo short to come from elsewhere"),
    ]
    got = {(r["row"]["conv_id"], r["row"]["turn"]): r for r in quotations.link_quotations(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    assert [got[1, t]["reply_to"] for t in range(7)] == [None, 0, 0, 1, None, 0, 3]
    assert sorted(range(7), key=lambda t: got[1, t]["position"]) == [0, 1, 3, 6, 2, 5, 4]
    assert [got[1, t]["depth"] for t in range(7)] == [0, 1, 1, 2, 0, 1, 3]
    assert got[1, 5]["n_quoted"] == 4 and got[1, 5]["body"] == "Why not?"
    assert got[2, 0]["reply_to"] is None and got[2, 0]["source_conv"] is None
    out = quotations.conversations(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert [r["text"] for r in out if r["conv_id"] == 1] == ["shall we meet on Monday", "Yes.", "Good, at ten then", "fine", "No.", "Why not?", "something else"]


def test_rewrapped_paragraphs_link(spark):
    rows = [(1, 0, "u", "first paragraph of words\n\nsecond paragraph of words"), (1, 1, "u", "> first paragraph\n> of words\n>\n> second paragraph\n> of words\nI see")]
    got = {r["row"]["turn"]: r for r in quotations.link_quotations(spark.createDataFrame(rows, CONVERSATIONS)).collect()}
    assert got[1]["reply_to"] == 0 and got[1]["body"] == "I see"


def frequent(n=3_600):
    """A third of all messages write one phrase and quote it, in one conversation and in many."""
    rows = []
    for i in range(n):
        conv, turn = (0, i) if i % 3 == 0 else (1 + i % 40, i)
        lines = ["> good morning to all of you"] * (i % 3 == 0) + ["good morning to all of you"] * (i % 3 == 0) + [f"> own words of number {i - 40 * 3}"] * (i % 5 == 0) + [f"own words of number {i}"]
        rows.append((conv, turn, "user", "\n".join(lines)))
    return rows


def agrees_with_sql(spark, folder, rows):
    spark.createDataFrame(rows, CONVERSATIONS).write.parquet(f"{folder}/conversations.parquet")
    got = queries.QUERIES["op1_quote_links"](spark, str(folder)).toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    assert rows_of(got) == rows_of(db.execute(queries.ORACLES["op1_quote_links"]).df())
    return got


def test_a_phrase_in_a_third_of_all_messages(spark, tmp_path):
    got = agrees_with_sql(spark, tmp_path, frequent())
    assert got["reply_to"].notna().sum() > 1_000 and got["depth"].max() > 5


def test_long_messages_and_long_chains(spark, tmp_path):
    rows = [(1, 0, "u", "a" + " " * 1_000_000 + "b"), (1, 1, "u", "> a b\n" + "\n" * 200_000 + " " * 300_000 + "x" + "\t" * 300_000 + "y"), (1, 2, "u", "\n".join(f"> line {i}" for i in range(30_000))), (1, 3, "u", " " * 500_000)]
    rows += [(2, t, "u", (f"> message number {t - 1}\n" if t else "") + f"message number {t}") for t in range(300)]
    begun = time.monotonic()
    got = agrees_with_sql(spark, tmp_path, rows)
    assert time.monotonic() - begun < 120
    chain = got[got["conv_id"] == 2].sort_values("turn")
    assert chain["depth"].tolist() == chain["position"].tolist() == list(range(300))


def test_quotations_of_nothing(spark):
    assert quotations.link_quotations(spark.createDataFrame([], CONVERSATIONS)).count() == 0


def test_quotations_run_without_python(spark):
    df = quotations.link_quotations(spark.createDataFrame(conversations(1), CONVERSATIONS))
    assert not re.search("Python|Pandas|ArrowEval", df._jdf.queryExecution().executedPlan().toString())


def test_sql_of_line_dedup_agrees_on_digests(spark, tmp_path):
    rows = [r for r in documents(4) if r[0] is not None and r[0] != 5 and r[0] != 3]
    table_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op10_line_dedup"](spark, str(tmp_path)).toPandas()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert rows_of(got) == rows_of(db.execute(queries.ORACLES["op10_line_dedup"]).df())
    kept = {r[0]: hashlib.sha256(r[3].encode()).hexdigest() for r in brute_lines(rows)}
    assert dict(zip(got["doc_id"], got["kept_sha256"], strict=True)) == kept


def test_any_number_of_quote_marks(spark):
    """A megabyte of marks in a line needs no deep stack; levels and bodies are those of SQL."""
    import duckdb

    rows = [(1, 1, "user", "hello there, all of you"), (1, 2, "user", ">" * 1_000_000 + " hello there, all of you"), (1, 3, "user", " > " * 350_000 + "hello there, all of you"), (1, 4, "user", "\t>" * 2_000 + "\n> hello there, all of you\nyes")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = quotations.link_quotations(messages)
    got = {r["turn"]: r for r in found.select("row.turn", "body", "n_quoted", "max_level", "reply_to").collect()}
    assert [(got[t]["n_quoted"], got[t]["max_level"], got[t]["reply_to"]) for t in (2, 3)] == [(1, 1_000_000, 1), (1, 350_000, 1)]
    assert got[4]["body"] == "yes" and got[4]["max_level"] == 2_000
    conversations = messages.toPandas()  # noqa: F841  read by the SQL
    want = duckdb.sql(quotations.OP1_SQL).df().sort_values("turn")
    assert want["max_level"].tolist() == [got[t]["max_level"] for t in (1, 2, 3, 4)] and want["n_quoted"].tolist() == [got[t]["n_quoted"] for t in (1, 2, 3, 4)]


def test_conversations_keep_columns_of_the_same_names(spark):
    rows = [(1, 1, "first message of all", 7, "x", 5), (1, 2, "> first message of all\nanswer", 8, "y", 6)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string, Position long, thread string, reply_position long")
    found = quotations.conversations(messages)
    assert found.columns == [*messages.columns, "reply_thread", "depth", "reply_reply_position"]
    assert [tuple(r) for r in found.collect()] == [(1, 1, "first message of all", 7, "x", 5, 1, 0, 0), (1, 2, "answer", 8, "y", 6, 1, 1, 1)]
