"""Secret scans: find candidates, then remove false positives with a random forest.

Native: candidates, their neighbouring words, all features and the forest itself
are column expressions; each tree is a nested CASE over the feature columns.
The forest is grown on the driver from labelled findings, written by hand and
generated, whose features are computed by the very same expressions.  Dictionary
coverage looks words up among the most frequent ones of the scanned texts
themselves, counted over all of them, and in a short fixed list.
"""

from __future__ import annotations

import json
import random
import string
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import findings as by_hand
from .support import table

#: A candidate is a whole run of at least 16 of these characters, with a digit among them or a known beginning.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9]|(?:AKIA|ASIA|gh[pos]_|sk_live_|AIza|eyJ|npm_))[A-Za-z0-9+/_-]{16,}+={0,2}"
#: What stands between a credential's name and its value.
_ASSIGN = r"""[A-Za-z0-9_-]{0,12}["'`]?[ \t]{0,3}[:=]{1,3}>?[ \t]{0,3}"""
_BARE = r"""[^\s"'`<>&,;]*[^\s"'`<>&,;.)\]}]"""
#: Code points of the text before and after a candidate that are looked at.
BEFORE, AFTER = 40, 24
#: Words that make up identifiers, placeholders and prose rather than secrets.
DICTIONARY = "example sample test dummy placeholder your change here secret token password value name user image version build commit hash uuid file path data main master release node item page section chapter index config default string number the and for with from this that have not are was order invoice report module class function method".split()
#: How known kinds of credentials begin, words before credentials, words before other long strings, and paths of examples.
KNOWN = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abpr]-|AIza|eyJ|ya29|SG_|npm_|dop_v1_)"
CREDENTIAL = r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?:orization)?|bearer|credentials?)"
OTHER = r"(?i)(?:sha-?\d*|md5|commit|checksum|digest|integrity|uuid|guid|etag|revision|build|order|invoice|tracking|isbn|phone|tel|card|account|serial|session|trace|request|image|png|href|src|url|https?)"
#: A candidate too: the value assigned to a credential, of any length; quoted, up to its closing quote; else up to white space, a quote or one of <>&,; (and without closing marks at its end).
_NAMED = f"(?<=(?:{CREDENTIAL}){_ASSIGN}"
ASSIGNED = "|".join([
    *[f"(?<={q})(?<=[:=>][ \\t]{{0,3}}{q}){_NAMED}{q})[^{q}\\n]++(?={q})" for q in "\"'`"],
    f"(?<=[:=> \\t])(?<=[:=>][ \\t]{{0,3}}){_NAMED})(?![=:>])(?!(?i:bearer|basic|token)[ \\t]){_BARE}",
    f"(?<=(?i:bearer|basic|token)[ \\t])(?<=(?i:authorization){_ASSIGN}(?i:bearer|basic|token)[ \\t]){_BARE}",
])
#: What every match of SEARCH has, or has before it: a plainer pattern that most texts fail sooner.
HINT = f"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{16}}|{CREDENTIAL.removeprefix('(?i)').replace('(?:pass', '(?i:pass', 1)}"
SEARCH = f"(?:{ASSIGNED})|{CANDIDATE}"
EXAMPLE_PATH = r"(?i)(?:test|example|sample|mock|fixture|spec|doc|demo|tutorial)"
PAIRS = r"(?i)(?=th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|ri|ro|ic|ne|ea|ra|ce)"

#: Documented bound: the most frequent words of the texts that make up the dictionary, of so many letters.
MOST_WORDS, LETTERS = 1_000, (4, 20)
#: Growing the forest: trees, levels, findings that a leaf has at least, and the seed.
TREES, LEVELS, LEAST, SEED = 15, 5, 4, 7


def dictionary(docs: DataFrame, *, text_col: str = "text", most: int = MOST_WORDS) -> list[str]:
    """The ``most`` most frequent lower-case words of a-z in all texts, capitals folded; of equally frequent ones the first by spelling."""
    low, high = LETTERS
    word = F.explode(F.regexp_extract_all(F.lower(f"`{text_col}`"), F.lit(f"(?<![a-z])[a-z]{{{low},{high}}}(?![a-z])"), F.lit(0)))
    counts = docs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row for each candidate: ``id``, ``nth`` (from 0), ``candidate``, ``before``, ``after`` and ``path``.

    Candidates are the values assigned to credentials, whatever their length and
    characters, and all runs that CANDIDATE names; the forest rejects.
    The text is split at candidates, so each has the gaps beside it, in time
    linear in the text.  A null text has no candidates; a null path is empty.
    """
    path = F.coalesce(F.col(f"`{path_col}`").cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), path.alias("path")).where(F.col("text").rlike(HINT))
    rows = rows.select("id", "path", F.regexp_extract_all("text", F.lit(SEARCH), F.lit(0)).alias("found"), F.split("text", SEARCH, -1).alias("gaps"))
    beside = F.transform("gaps", lambda g: F.struct(F.right(g, F.lit(BEFORE)).alias("before"), F.left(g, F.lit(AFTER)).alias("after")))
    rows = rows.select("id", "path", "found", beside.alias("beside"))
    rows = rows.select("id", "path", F.posexplode("found").alias("nth", "candidate"), "beside")
    return rows.select("id", F.col("nth").cast("long").alias("nth"), "candidate", F.get("beside", F.col("nth"))["before"].alias("before"), F.get("beside", F.col("nth") + 1)["after"].alias("after"), "path")


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.char_length(c)


def features(words: list[str] | None = None) -> dict[str, Column]:
    """What the forest sees of a candidate, as numbers; ``words`` is the dictionary besides the fixed list."""
    c, before, after, path = F.col("candidate"), F.col("before"), F.col("after"), F.col("path")
    length = F.char_length(c)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    covered = F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), "")
    near = F.right(before, F.lit(24))
    # capitals begin a word in names such as userToken
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(c, "(?<=[a-z])(?=[A-Z])", " ")), F.lit("[a-z]{3,}"), F.lit(0))
    named = F.filter(runs, lambda x: x.isin([*DICTIONARY, *(words or [])]))
    return {
        "f_length": length.cast("double"),
        "f_digits": _share(c, "[0-9]"),
        "f_upper": _share(c, "[A-Z]"),
        "f_lower": _share(c, "[a-z]"),
        "f_marks": _share(c, "[+/_=-]"),
        "f_symbols": _share(c, "[^A-Za-z0-9+/_=-]"),
        "f_turns": _share(c, "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"),
        "f_pairs": _share(c, PAIRS),
        "f_runs": _share(c, r"(?=(.)\1)"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(length, F.lit(40)),
        "f_hex": flag(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "f_known": flag(c.rlike(KNOWN)),
        "f_dictionary": 1 - F.char_length(covered) / length,
        "f_words": F.aggregate(named, F.lit(0), lambda a, x: a + F.char_length(x)) / length,
        "f_credential": flag(near.rlike(CREDENTIAL)),
        "f_other": flag(near.rlike(OTHER)),
        "f_assigned": flag(before.rlike("[:=]\\s*[\"'`]?$")),
        "f_quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "f_in_path": flag(before.rlike(r"(?:/|\\|://\S*|[?&]\w+=|\.)$") | after.rlike(r"^(?:/|\.\w|@)")),
        "f_example_path": flag(path.rlike(EXAMPLE_PATH)),
    }


def labelled_findings(n: int = 1200, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """Findings (candidate, before, after, path, label) to learn from: credentials in use, and what is often taken for them."""
    r = random.Random(seed)
    some = lambda letters, low, high: "".join(r.choice(letters) for _ in range(r.randint(low, high)))
    mixed, upper, hexes = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
    words = lambda k: " ".join(r.choice(DICTIONARY) for _ in range(k))
    paths = ["src/app.py", "config/prod.yml", "deploy/env", "notes/a.md", "src7", "web/main.js"]
    out = []
    for _ in range(n):
        path = r.choice(paths) if r.random() < 0.9 else r.choice(["tests/test_a.py", "docs/example.md"])
        secret = r.random() < 0.5
        quote = r.choice(['"', "'", ""])
        named = words(2) + " " + r.choice(["password", "passwd", "pwd", "token", "secret", "api_key"]) + r.choice(["=", " = ", ": "])
        if r.random() < 0.4:
            before = named
            if secret:
                kind = r.random()
                if kind < 0.4:
                    c = r.choice(["hunter", "sun", "dragon", "winter", "blue", "maria", "tiger"]) + some(string.digits, 1, 4) + r.choice(["", "secret", "pass", "!", "x", "Moon"])
                elif kind < 0.7:
                    c = some(mixed + "!#%*@$?^+", 8, 16)
                    c = c[:4] + r.choice("!#%*@$?") + c[4:] + r.choice(string.digits)
                else:
                    c = some(string.ascii_letters, 16, 32)
            else:
                c = r.choice([
                    lambda: r.choice(DICTIONARY),
                    lambda: r.choice(["null", "None", "true", "false", "required", "string", "changeme", "xxxx", "******", "str", "undefined", "empty", "expired", "invalid"]),
                    lambda: r.choice(["$", "${", "{{", "%", "os.environ.", "config.", "self.", "process.env."]) + r.choice(DICTIONARY).upper() + r.choice(["", "}", "_", "()"]),
                    lambda: r.choice(["your", "my", "the", "example"]) + r.choice(["_", "-", " "]) + r.choice(DICTIONARY),
                ])()
        elif secret:
            kind = r.random()
            if kind < 0.3:
                c, before = r.choice(["AKIA", "ASIA"]) + some(upper, 16, 16), words(3) + r.choice([" ", ", ", ": ", " key="])
                quote = ""
            elif kind < 0.45:
                c, before = r.choice(["ghp_", "glpat-", "sk_live_", "AIza", "npm_"]) + some(mixed, 24, 36), words(2) + r.choice([" ", " token=", ": "])
            elif kind < 0.75:
                c, before = some(hexes, 16, 40), words(2) + " " + r.choice(["password", "passwd", "token", "secret", "api_key", "auth_token"]) + r.choice(["=", " = ", ": "])
            else:
                c, before = some(mixed + "+/", 20, 44), words(2) + " " + r.choice(["password", "secret", "access_key", "token", "Authorization"]) + r.choice(["=", ": ", " = "])
        else:
            kind = r.random()
            if kind < 0.18:
                c, before = some(hexes, 32, 40), words(2) + " " + r.choice(["commit ", "sha1: ", "md5=", "checksum ", "etag: "])
            elif kind < 0.3:
                c, before = "-".join(some(hexes, k, k) for k in (8, 4, 4, 4, 12)), words(2) + r.choice([" uuid ", " id=", " ", " request "])
            elif kind < 0.45:
                c, before = r.choice(["_", "-", "/"]).join(r.choice(DICTIONARY) for _ in range(r.randint(3, 5))) + str(r.randint(0, 99)), words(2) + r.choice([" ", " /", " = "])
            elif kind < 0.6:
                c, before = some(string.digits, 16, 20), words(3) + r.choice([" ", ", ", " card ", " order ", ": "])
            elif kind < 0.7:
                c, before = "".join(r.choice(["ther", "ing", "ation", "ent", "on", "er", "st", "re", "and", "le"]) for _ in range(r.randint(5, 9))) + str(r.randint(1, 9)), words(3) + " "
            elif kind < 0.82:
                c, before = some(mixed, 20, 40), words(1) + r.choice([" https://host/", " src=/img/", " url /a/", " image "])
            else:
                c = r.choice(["your", "example", "test", "changeme", "xxxx"]) + r.choice(["_", "-", ""]) + r.choice(["token", "secret", "password", "0000", "xxxxxxxx"]) + r.choice(["_here_1", "12345678", "00000000"])
                before = words(2) + " " + r.choice(["password", "token", "api_key"]) + r.choice(["=", ": "])
                c = c if len(c) >= 16 else c + "0" * (16 - len(c))
        out.append((c, (before + quote)[-BEFORE:], quote + r.choice([" ", "\n", ", ", " " + words(1)]), path, int(secret)))
    return out


Tree = tuple | float


def _grown(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, level: int = 0) -> Tree:
    """A tree as nested (feature, threshold, left, right); a leaf is its share of secrets."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if level == LEVELS or len(y) < 2 * LEAST or y.min() == y.max():
        return float(share)
    best: tuple = (0.0,)
    for j in rng.choice(x.shape[1], max(2, int(x.shape[1] ** 0.5) + 1), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, ones = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y))
        p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
        gain = len(y) * y.mean() * (1 - y.mean()) - n * p * (1 - p) - (len(y) - n) * q * (1 - q)
        gain[(v[1:] <= v[:-1]) | (n < LEAST) | (len(y) - n < LEAST)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), int(j), float((v[k] + v[k + 1]) / 2))
    if len(best) == 1:
        return float(share)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grown(x[left], y[left], rng, level + 1), _grown(x[~left], y[~left], rng, level + 1))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> list[Tree]:
    """A random forest: each tree sees a bootstrap of the findings, each split some of the features."""
    out = []
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        rows = rng.integers(0, len(y), len(y))
        out.append(_grown(x[rows], y[rows], rng))
    return out


def tree_column(tree: Tree, names: list[str]) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    j, threshold, left, right = tree
    return F.when(F.col(names[j]) <= threshold, tree_column(left, names)).otherwise(tree_column(right, names))


def labelled_lines(copies: int = 8, seed: int = SEED) -> list[tuple[str, str, list[str]]]:
    """The lines written by hand, each drawn some times."""
    return [x for i in range(copies) for x in by_hand.written(by_hand.LINES, seed + i)]


def _given(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a literal of the plan, so that no task needs Python."""
    names = [f.split(":")[0] for f in schema.replace("array<string>", "list").split(",")]
    return spark.sql(f"SELECT inline(from_json(:given, 'array<struct<{schema}>>'))", args={"given": json.dumps([dict(zip(names, x, strict=True)) for x in rows])})


def fit(spark: SparkSession, findings: list[tuple[str, str, str, str, int]] | None = None, lines: list[tuple[str, str, list[str]]] | None = None, words: list[str] | None = None) -> list[Tree]:
    """Grow the forest from labelled findings (candidate, before, after, path, label) and lines (text, path, secrets).

    Some thousands at most, given by the caller, never rows of the corpus.  Those
    kept here are used where neither is given (None); an empty list is empty.  A
    line's candidates are labelled by whether they hold one of its secrets.
    """
    if findings is None and lines is None:
        findings, lines = labelled_findings(), labelled_lines()
    seen = _given(spark, findings or [], "candidate:string,before:string,after:string,path:string,label:bigint")
    texts = _given(spark, [(t, p, s) for t, p, s in lines or []], "text:string,path:string,secrets:array<string>")
    found = candidates(texts.withColumn("id", F.struct("path", "secrets")), id_col="id", path_col="path")
    holds = F.exists("id.secrets", lambda x: F.contains(F.col("candidate"), x)).cast("long")
    seen = seen.unionByName(found.select("candidate", "before", "after", "path", holds.alias("label")))
    names = list(features())
    rows = seen.select("label", *[f.alias(n) for n, f in features(words).items()])
    data = np.array([tuple(r) for r in rows.collect()], float).reshape(-1, 1 + len(names))
    if not len(data):
        raise ValueError("a forest needs labelled findings")
    data = data[np.lexsort(data.T[::-1])]
    return grow(data[:, 1:], data[:, 0])


def scan(docs: DataFrame, forest: list[Tree], *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", words: list[str] | None = None) -> DataFrame:
    """Every candidate with ``score`` (the trees' mean) and ``is_secret`` (score of 0.5 or more).

    Defined cases: a null or empty text has no findings; ids may be null or
    repeat; a candidate that occurs twice is found twice; other columns may have
    any names; an empty table gives an empty result.  ``words`` is the dictionary
    that the forest was fitted with.

    What is never a candidate, and so never found: a run of fewer than 16
    characters, or without a digit or a known beginning, that no credential's
    name stands before (CANDIDATE, ASSIGNED).
    """
    names = list(features())
    seen = candidates(docs, id_col=id_col, text_col=text_col, path_col=path_col).select("*", *[f.alias(n) for n, f in features(words).items()])
    votes = reduce(lambda a, b: a + b, [tree_column(t, names) for t in forest])
    scored = seen.withColumn("score", F.round(votes / len(forest), 6))
    return scored.select(F.col("id").alias(id_col), "nth", "candidate", "before", "after", "score", (F.col("score") >= 0.5).alias("is_secret"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in all documents, with the forest's verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    words = dictionary(docs)
    found = scan(docs, fit(spark, words=words), words=words)
    return found.select("doc_id", "nth", F.char_length("candidate").cast("long").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
