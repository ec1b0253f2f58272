"""Benchmark decontamination with sharded suffix arrays over the training texts.

Each task turns the documents that it reads, some megabytes at a time, into a
shard: the word ids of all its documents (words no test item has are 0) and the
sorted array of their suffixes.  Every test suffix is looked up in the shard by
binary search; the range found holds all its verbatim occurrences, which are
then extended as far as both sides agree.  Suffixes that start with no test
n-gram can't be found by any search and are left out of the array, so it stays
small.  Nothing is shuffled: documents keep their place, and a passage that a
third of them share costs no more than its own length.

The test side is broadcast only up to ``block_bytes`` of text; a larger one is
looked up block by block, and only what a block finds is staged.  Blocks are dealt
by a hash of item and text, and made smaller until the largest is within the
bound, or is a single item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .support import shipped, staged, table, tidy
from .textspans import ALNUM, LOWER, buffers, groups, spans, word_hashes

#: Words of a window; an item with fewer words is one window.
WINDOW = 10
#: Suffixes are ordered by so many words; beyond, matches are extended word by word.
DEPTH = 16
#: First words by which suffixes that no search can reach are left out.
PREFIX = 4
#: The test texts that are broadcast at a time; their index takes some twenty times as much.
BLOCK_BYTES = 16 << 20
_SLOTS = 22


@dataclass
class TestSide:
    """The words, suffixes and windows of a block of test items."""

    items: list[str]
    vocabulary: np.ndarray  # sorted hashes; a word's id is its place + 1
    slot: np.ndarray
    crowded: np.ndarray
    word_bytes: np.ndarray
    word_at: np.ndarray
    word_length: np.ndarray
    tokens: np.ndarray  # of all items, a 0 after each
    starts: np.ndarray  # in tokens, of each suffix that begins a window
    item_of: np.ndarray
    length: np.ndarray  # of its window
    window_of: np.ndarray  # equal windows have one number
    first: np.ndarray  # a suffix of each window number
    low: np.ndarray
    high: np.ndarray
    prefixes: dict[int, np.ndarray]
    bits: int


def _packed(tokens: np.ndarray, at: np.ndarray, words: int, bits: int) -> np.ndarray:
    key = tokens[at].astype(np.int64)
    for j in range(1, words):
        key = key << bits | tokens[at + j]
    return key


def _rows(tokens: np.ndarray, at: np.ndarray, depth: int, until: np.ndarray | None = None, fill: int = 0) -> np.ndarray:
    """The ``depth`` words from each place as bytes that compare like the words; after a 0, or from ``until`` on, ``fill``."""
    grid = tokens[np.minimum(at[:, None] + np.arange(depth), len(tokens) - 1)].astype(">u4")
    ended = np.logical_or.accumulate(grid == 0, axis=1) if until is None else np.arange(depth) >= until[:, None]
    grid[ended] = fill
    return np.ascontiguousarray(grid).view(f"S{4 * depth}").ravel()


def test_side(items: list[tuple[object, str | None]], window: int = WINDOW) -> TestSide:
    """Index a block of (item_id, text)."""
    column = pa.array([t or "" for _, t in items], pa.large_string())
    raw, offsets = buffers(column)
    data = LOWER[raw]
    starts, ends, counts = spans(data, offsets, ALNUM)
    hashes = word_hashes(data, starts, ends)
    vocabulary, firsts, ids = np.unique(hashes, return_index=True, return_inverse=True)
    item_of_word = np.repeat(np.arange(len(items)), counts)
    tokens = np.zeros(len(ids) + len(items) + 1, np.int32)
    at = np.arange(len(ids)) + item_of_word
    tokens[at] = ids + 1
    left = (np.cumsum(counts)[item_of_word] if len(ids) else np.zeros(0, np.int64)) - np.arange(len(ids))
    size = np.minimum(window, counts)[item_of_word]
    own = left >= size
    depth, bits = max(DEPTH, window), max(1, int(len(vocabulary)).bit_length())
    places, length, item_of = at[own], size[own], item_of_word[own]
    low = _rows(tokens, places, depth, length)
    labelled = np.char.add(low, np.char.add(b"#", length.astype("S"))) if len(low) else low
    _, first, window_of = np.unique(labelled, return_index=True, return_inverse=True)
    words = [min(PREFIX, 63 // bits, n) for n in range(1, window + 1)]
    prefixes = {}
    for n in sorted({words[k - 1] for k in length.tolist()}):
        of = np.array([words[k - 1] == n for k in length.tolist()], bool)
        prefixes[n] = np.unique(_packed(tokens, places[of], n, bits))
    slot = np.zeros(1 << _SLOTS, np.int32)
    cell = (vocabulary >> np.uint64(64 - _SLOTS)).astype(np.int64)
    slot[cell] = np.arange(len(vocabulary))
    crowded = np.bincount(cell, minlength=1 << _SLOTS) > 1
    word_length = (ends - starts)[firsts]
    return TestSide(
        [str(i) for i, _ in items], vocabulary, slot, crowded, data, starts[firsts], word_length, tokens, places, item_of, length, window_of,
        first, low[first], _rows(tokens, places, depth, length, 0xFFFFFFFF)[first], prefixes, bits,
    )


def _ids(side: TestSide, hashes: np.ndarray) -> np.ndarray:
    cell = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
    found = side.slot[cell]
    same = side.vocabulary[found] == hashes
    if (unsure := np.flatnonzero(side.crowded[cell] & ~same)).size:
        place = np.minimum(np.searchsorted(side.vocabulary, hashes[unsure]), len(side.vocabulary) - 1)
        found[unsure], same[unsure] = place, side.vocabulary[place] == hashes[unsure]
    return np.where(same, found + 1, 0).astype(np.int32)


def _suffix_array(side: TestSide, tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the shard's suffixes that some search can reach, in order, and their rows."""
    reach = np.zeros(len(tokens), bool)
    live = np.flatnonzero(tokens)
    for n in range(1, max(side.prefixes, default=0) + 1):
        if n > 1:
            live = live[tokens[live + n - 1] > 0]  # a 0 ends every document, so this never leaves the array
        if n in side.prefixes:
            keys, wanted = _packed(tokens, live, n, side.bits), side.prefixes[n]
            reach[live[wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys]] = True
    places = np.flatnonzero(reach)
    rows = _rows(tokens, places, depth)
    order = np.argsort(rows, kind="stable")
    return places[order], rows[order]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of the ranges [low, high), and the number of its range."""
    counts = high - low
    of = np.repeat(np.arange(len(low)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + low[of], of


def _verified(side: TestSide, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray, at: np.ndarray, word_of: np.ndarray) -> bool:
    """Compare the covered words byte by byte with the test words of their ids; one that only shares a hash becomes 0."""
    ids, own = tokens[at] - 1, word_of[at]
    length = ends[own] - starts[own]
    same = length == side.word_length[ids]
    here, of = _spread(starts[own][same], ends[own][same])
    there, _ = _spread(side.word_at[ids][same], side.word_at[ids][same] + length[same])
    differs = data[here] != side.word_bytes[there]
    wrong = ~same
    wrong[np.flatnonzero(same)[np.unique(of[differs])]] = True
    tokens[at[wrong]] = 0
    return not wrong.any()


@dataclass
class Found:
    n_words: int
    covered: np.ndarray
    items: set[int]
    matches: list[tuple[int, int, int, int]]  # item, first word in the document, in the item, words
    longest: tuple[int, int, int] | None = None  # words, first word in the document, item


def search(side: TestSide, raw: np.ndarray, offsets: np.ndarray, matches: bool = True) -> list[Found]:
    """Look all test suffixes up in one shard of documents; with ``matches`` also extend what is found."""
    data = LOWER[raw]
    starts, ends, counts = spans(data, offsets, ALNUM)
    out = [Found(int(n), np.zeros(0, np.int64), set(), []) for n in counts]
    if not len(starts) or not len(side.vocabulary):
        return out
    doc_of_word = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(starts)) + doc_of_word
    tokens = np.zeros(len(starts) + len(counts) + 1, np.int32)
    tokens[at] = _ids(side, word_hashes(data, starts, ends))
    word_of = np.zeros(len(tokens), np.int64)
    word_of[at] = np.arange(len(starts))
    depth = side.low.dtype.itemsize // 4
    while True:
        places, rows = _suffix_array(side, tokens, depth)
        if not len(places):
            return out
        low, high = np.searchsorted(rows, side.low, "left"), np.searchsorted(rows, side.high, "right")
        hit, window = _spread(low, high)
        hit = places[hit]
        if not len(hit):
            return out
        edge = np.zeros(len(tokens) + 1, np.int32)
        length = side.length[side.first]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + length[window], -1)
        covered = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        if _verified(side, data, starts, ends, tokens, covered, word_of):
            break
    first_word = np.cumsum(counts) - counts
    for doc, words in _by(doc_of_word[word_of[covered]], word_of[covered]):
        out[doc].covered = words - first_word[doc]
    order = np.argsort(side.window_of, kind="stable")
    edges = np.searchsorted(side.window_of[order], np.arange(len(side.first) + 1))
    # a window counts once in a document, however often it stands there; equal windows of several items name all of them
    pairs = np.unique(np.stack([doc_of_word[word_of[hit]], window], 1), axis=0)
    which, of = _spread(edges[pairs[:, 1]], edges[pairs[:, 1] + 1])
    for d, i in np.unique(np.stack([pairs[of, 0], side.item_of[order[which]]], 1), axis=0).tolist():
        out[d].items.add(i)
    first_token = np.searchsorted(side.item_of, np.arange(len(side.items)))
    rank = np.argsort(np.argsort(np.array(side.items, dtype=object), kind="stable"), kind="stable")
    for some in _portions(edges[window + 1] - edges[window]):
        suffix, place, size = _extended(side, tokens, hit[some], window[some], order, edges)
        word, item = word_of[place], side.item_of[suffix]
        doc = doc_of_word[word]
        best = np.lexsort((rank[item], word, -size, doc))
        for k in best[np.concatenate([[True], doc[best][1:] != doc[best][:-1]])[: len(best)]].tolist():
            d, now = int(doc[k]), (int(size[k]), int(word[k] - first_word[doc[k]]), int(item[k]))
            old = out[d].longest
            if old is None or (-now[0], now[1], rank[now[2]]) < (-old[0], old[1], rank[old[2]]):
                out[d].longest = now
        if matches:
            for d, s, h, n in zip(doc.tolist(), suffix.tolist(), place.tolist(), size.tolist(), strict=True):
                i = int(side.item_of[s])
                out[d].matches.append((i, int(word_of[h] - first_word[d]), int(side.starts[s] - side.starts[first_token[i]]), n))
    return out


#: Pairs of an occurrence and a test suffix that are extended together, about.
EXTENDED = 1 << 20


def _portions(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of what expands to so many each; ``EXTENDED`` in all, but for a single larger one."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + EXTENDED, "right")))
        yield slice(start, stop)
        start = stop


def _extended(side: TestSide, tokens: np.ndarray, hit: np.ndarray, window: np.ndarray, order: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where verbatim matches begin (test suffix, place in the shard), and how many words both sides agree on from there."""
    which, of = _spread(edges[window], edges[window + 1])
    suffix, hit = order[which], hit[of]
    here, there = hit, side.starts[suffix]
    longest = (here == 0) | (there == 0) | (tokens[here - 1] == 0) | (tokens[here - 1] != side.tokens[there - 1])
    suffix, hit = suffix[longest], hit[longest]
    size = side.length[suffix].astype(np.int64)
    growing = np.arange(len(suffix))
    while len(growing):
        mine, theirs = tokens[hit[growing] + size[growing]], side.tokens[side.starts[suffix[growing]] + size[growing]]
        growing = growing[(mine == theirs) & (mine > 0)]
        size[growing] += 1
    return suffix, hit, size


def _by(key: np.ndarray, value: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The values of each key; keys come in order."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    for part in np.split(np.arange(len(key)), cuts):
        if len(part):
            yield int(key[part[0]]), value[part]


MATCH = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("doc_word", T.LongType()), T.StructField("item_word", T.LongType()), T.StructField("words", T.LongType())])
LONGEST = T.StructType([T.StructField("words", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("item_id", T.StringType())])
_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("covered", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(MATCH)),
    T.StructField("longest", LONGEST),
]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None, matches: bool = True) -> DataFrame:
    """Look every test suffix up in all documents.

    Returns ``row`` (a struct of the columns ``keep`` of ``docs``, else of all), ``n_words``,
    ``covered`` (the places of the words inside occurring windows), ``items``
    (sorted item ids), ``longest`` (the longest verbatim match: words, its first
    word in the document, item; of equal ones the first, then the smallest item
    id; null if there is none) and ``matches`` (all that can't be made longer:
    item, first word in the document and in the item, words; empty without
    ``matches``, as a repeated passage gives many), one row for each row.

    A benchmark of more than ``block_bytes`` is looked up block by block: the
    documents are written once, with a number; each block reads their texts and
    leaves only what it found, by number, and the last step joins it to them.

    Defined cases: a null or empty text has no words; an item without words is
    never found; rows that repeat an item id are that item's texts, each with
    its own windows; rows that are quite alike are one; a null item id counts as
    the id "None"; an empty benchmark leaves all documents clean; other columns may have any names.
    """
    spark = shipped(docs.sparkSession)
    texts = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).distinct()
    total, largest = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-total // block_bytes))
    of = lambda n: F.pmod(F.xxhash64("id", "text"), F.lit(n))
    items = lambda block: [tuple(x) for x in block.orderBy("id", "text").collect()]  # noqa: E731  of bounded size
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if blocks == 1:
        return _pass(spark, docs.select(whole), items(texts), window, text_col, keep or docs.columns, matches)
    texts = staged(texts, "items")
    most = max(block_bytes, largest)
    while texts.groupBy(of(blocks)).agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] > most:
        blocks += -(-blocks // 4)
    rows = staged(docs.select(whole, F.monotonically_increasing_id().alias("number")), "rows")
    read = rows.select(F.struct("number", F.col(f"row.`{text_col}`").alias("text")).alias("row"))
    found = []
    for b in range(blocks):
        here = _pass(spark, read, items(texts.where(of(blocks) == b)), window, "text", ["number"], matches)
        found.append(staged(here.where((F.size("covered") > 0) | F.lit(b == 0)).select("row.number", F.lit(b).alias("block"), *[f.name for f in _FOUND]), "found"))
    # a row has an entry for each block that it has a window of
    every = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", c))), lambda x: x[c]))
    better = F.struct(-F.col("longest.words"), F.col("longest.doc_word"), F.col("longest.item_id"))
    merged = reduce(DataFrame.unionAll, found).groupBy("number").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(every("covered"))).alias("covered"),
        F.array_sort(F.array_distinct(every("items"))).alias("items"),
        every("matches").alias("matches"),
        F.min_by("longest", F.when(F.col("longest").isNotNull(), better)).alias("longest"),
    )
    return rows.join(merged, "number").select(F.struct(*[F.col(f"row.`{c}`") for c in keep or docs.columns]).alias("row"), *[f.name for f in _FOUND])


def _pass(spark: SparkSession, rows: DataFrame, items: list[tuple[object, str | None]], window: int, text_col: str, keep: list[str], extended: bool) -> DataFrame:
    """Look a block of items up in the texts of ``row``, of which the columns ``keep`` stay."""
    side = spark.sparkContext.broadcast(test_side(items, window))
    names = rows.schema["row"].dataType.names
    text, kept = names.index(text_col), [names.index(c) for c in keep]
    schema = T.StructType([T.StructField("row", T.StructType([rows.schema["row"].dataType.fields[i] for i in kept])), *_FOUND])
    arrow = [to_arrow_type(f.dataType) for f in _FOUND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = side.value
        for batch in batches:
            row = batch.column(0)
            data, offsets = buffers(row.field(text))
            row = pa.StructArray.from_arrays([row.field(i) for i in kept], fields=[row.type.field(i) for i in kept])
            for a, b in groups(offsets):
                found = search(own, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], extended)
                columns = (
                    [f.n_words for f in found],
                    [f.covered.tolist() for f in found],
                    [sorted({own.items[i] for i in f.items}) for f in found],
                    [[dict(zip(MATCH.names, (own.items[i], *m), strict=True)) for i, *m in f.matches] for f in found],
                    [f.longest and {"words": f.longest[0], "doc_word": f.longest[1], "item_id": own.items[f.longest[2]]} for f in found],
                )
                yield pa.RecordBatch.from_arrays([row.slice(a, b - a), *[pa.array(x, kind) for x, kind in zip(columns, arrow, strict=True)]], schema.names)

    return rows.mapInArrow(tidy(run), schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no test window occurs, with the columns they came with."""
    return find_leaks(docs, benchmark, matches=False, **options).where(F.size("covered") == 0).select("row.*")


def op7_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside occurring test windows, the items that occur in it, and the longest verbatim match."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = find_leaks(docs, items, keep=["doc_id"], matches=False)
    return found.select(
        "row.doc_id",
        "n_words",
        F.size("covered").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("covered") > 0).alias("contaminated"),
        F.col("longest.words").alias("longest_words"),
        F.col("longest.doc_word").alias("longest_at"),
        F.col("longest.item_id").alias("longest_item"),
    )


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bq AS (SELECT t, item_id, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS q, unnest([array_to_string(w[p:p + least(10, len(w)) - 1], ' ') FOR p IN range(1, len(w) - least(10, len(w)) + 2)]) AS s FROM (SELECT *, row_number() OVER () AS t FROM b) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, s FROM bq),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS p, unnest([array_to_string(w[p:p + n - 1], ' ') FOR p IN range(1, len(w) - n + 2)]) AS s FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT r, p, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS place FROM hits) GROUP BY r),
runs AS (SELECT r, t, item_id, n, p, q, p - row_number() OVER (PARTITION BY r, t, n, p - q ORDER BY p) AS run FROM dw JOIN bq USING (n, s)),
longest AS (SELECT r, count(*) + n - 1 AS longest_words, min(p) - 1 AS longest_at, coalesce(CAST(item_id AS VARCHAR), 'None') AS longest_item FROM runs GROUP BY r, t, item_id, n, p - q, run
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY longest_words DESC, longest_at, longest_item) = 1),
found AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT r, coalesce(CAST(item_id AS VARCHAR), 'None') AS i FROM hits) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(longest_words AS BIGINT) AS longest_words, CAST(longest_at AS BIGINT) AS longest_at, longest_item
FROM d LEFT JOIN words ON d.r = words.r LEFT JOIN found ON d.r = found.r LEFT JOIN longest ON d.r = longest.r
"""
