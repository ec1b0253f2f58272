"""Small tables with what is hard: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(seed: int = 1, n: int = 120) -> list[tuple]:
    r = random.Random(seed)
    shared = [prose(r, 8) for _ in range(4)]
    rows = []
    for i in range(n):
        lines = [prose(r, r.randint(0, 12)) for _ in range(r.randint(1, 6))]
        for s in shared:
            if r.random() < 0.15:
                lines.insert(r.randint(0, len(lines)), r.choice([s, s.upper(), f" {s}\t"]))
        rows.append((i, "\n".join(lines), r.choice(["en", "fr", None]), f"src{i % 3}", 0))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, "\n\n", "en", "s", 2), (n + 3, " \t\x0b\x0c\r", "en", "s", 5)]
    rows += [rows[3], (5, rows[6][1], "en", "s", 1), (None, rows[3][1], "en", "s", 1), (None, None, None, None, None)]
    rows += [(n + 4, "word " * 20_000, "en", "s", 100_000), (n + 5, "ÀÉ日本 ñandú tail\u0085 <b>&amp;</b> 'quote' \"x\" \\ end", "en", "s", 9)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """The same with columns named like what operators work with."""
    for name in ("id", "row", "pos", "key", "score", "kept", "lines", "fp", "label", "text_hash", "n_words", "a.b", "root", "h1", "dropped"):
        df = df.withColumn(name, F.lit("x"))
    return df


def labels(rows):
    """Quality 0 for texts that shout; toxic 1 for those with a certain word."""
    return [(r[0], int("!!" not in (r[1] or "")), int("idiot" in (r[1] or "").lower())) for r in rows if r[0] is not None]
