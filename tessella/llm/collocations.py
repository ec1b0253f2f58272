"""Phrase collocation mining with generalised suffix automata of bounded depth.

A task reads its texts in shards of about half a million words and builds each
shard's automaton: the states are classes of phrases, up to four words long, that
end at the same places.  A state knows its longest phrase, its shortest, its
suffix link (the longest suffix that ends at more places) and how many places
there are.  It is built depth by depth with numpy: a phrase of d words is its
first d - 1 and one word more, and its link that without the first word; phrases
with as many places as their link share its state.

Counts of all shards are summed by phrase.  To keep most phrases, which are rare,
out of that shuffle, words are counted first, then pairs of frequent words by
64-bit hashes, then what holds frequent pairs alone, word by word.  Frequent
words and pairs are sent to the tasks as a bitmap of ``FILTER_BITS`` bits,
whatever their number: a hash that meets another one's bit only lets a rare
phrase through to the exact count, and a fuller bitmap spares less.  No count
depends on a hash.

A phrase that a longer one holds is a suffix or a beginning of one that is one
word longer and at least as frequent as the longer one, so each phrase tells its
suffix link, and the same without the last word, its own count.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .support import shipped, split_join, staged, staged_alone, table, tidy

#: Words of a phrase, at most; occurrences at least; the share (in hundredths) of a phrase's occurrences inside a longer one that drops it; phrases of a language.
DEPTH, LEAST, SUBSUMED, TOP = 4, 30, 80, 2_000
#: Words of a shard, about, and bits of the bitmap of frequent words or pairs (16 MB).
SHARD_WORDS, FILTER_BITS = 1 << 19, 27
#: What ends a piece of text, within which phrases lie.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Groups in which a language's phrases are ranked before they meet.
RANKED_IN = 64

#: A byte that no UTF-8 text has stands for the end of a piece.
_MARK = b"\xff"
_FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS, b"abcdefghijklmnopqrstuvwxyz" + _MARK * len(ENDS))
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Automaton:
    """States of a shard, by the place (index) at which their longest phrase first ends."""

    words: np.ndarray  #: the shard's words as numbers, -1 between pieces
    end: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray
    places: np.ndarray
    link: np.ndarray  #: the state of the longest suffix that ends at more places, -1 for the empty phrase


def automaton(words: np.ndarray, depth: int, pair: np.ndarray | None = None) -> Automaton:
    """The suffix automaton of all pieces, for phrases of up to ``depth`` words.

    ``pair`` says of each place whether the pair that ends there may be part of
    a phrase.
    """
    size = int(words.max(initial=-1)) + 1
    node = words.astype(np.int64)  # of each place: the number of the phrase of d words that ends there
    known = np.flatnonzero(node >= 0)
    used, first, node_of, places = np.unique(node[known], return_index=True, return_inverse=True, return_counts=True)
    node = np.full(len(words), -1, np.int64)
    node[known] = node_of
    one = node.copy()
    # one entry for each phrase, depth by depth
    ends, lengths, counts, links, base = [known[first]], [np.ones(len(used), np.int64)], [places], [np.full(len(used), -1, np.int64)], 0
    for d in range(2, depth + 1):
        before, here = np.concatenate([[-1], node[:-1]]), node
        valid = (before >= 0) & (here >= 0)
        if pair is not None and d == 2:
            valid &= pair
        at = np.flatnonzero(valid)
        if not len(at):
            break
        _, first, node_of, places = np.unique(before[at] * max(1, size) + one[at], return_index=True, return_inverse=True, return_counts=True)
        links.append(base + here[at[first]])
        ends.append(at[first])
        lengths.append(np.full(len(first), d))
        counts.append(places)
        base += len(counts[-2])
        node = np.full(len(words), -1, np.int64)
        node[at] = node_of
    end, length, places, link = map(np.concatenate, (ends, lengths, counts, links))
    # a phrase with as many places as its link belongs to the link's state; only one can, as places of others would be more
    joins = (link >= 0) & (places == places[link])
    state, shortest = np.arange(len(end)), length.copy()
    for d in range(2, depth + 1):  # links go to shorter phrases, which are done
        now = np.flatnonzero(joins & (length == d))
        shortest[now] = shortest[link[now]]
    top = np.ones(len(end), bool)
    top[link[joins]] = False
    # each state is named by its longest phrase; shorter ones follow the chain upwards
    for d in range(depth, 1, -1):
        now = np.flatnonzero(joins & (length == d))
        state[link[now]] = state[now]
    number = np.cumsum(top) - 1
    root = np.arange(len(end))
    for d in range(2, depth + 1):
        now = np.flatnonzero(joins & (length == d))
        root[now] = root[link[now]]
    out = link[root]
    return Automaton(words, end[top], length[top], shortest[top], places[top], np.where(out[top] >= 0, number[state[out[top]]], -1))


class _Shard:
    """The words of some texts as numbers, each language with words of its own."""

    def __init__(self) -> None:
        fresh = count()
        self.number: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(fresh.__next__))
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: bytes) -> None:
        tokens = text.translate(_FOLDED).replace(_MARK, b" \xff ").split()  # only blanks and tabs are left of white space
        number = self.number[lang]
        self.parts += [np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens)), np.array([-1])]
        self.size += len(tokens)

    def closed(self) -> tuple[list[bytes], list[str], np.ndarray]:
        """Names and languages of the numbers, and the numbers in order, -1 between pieces."""
        total = sum(map(len, self.number.values()))
        names, langs = [b""] * total, [""] * total
        for lang, words in self.number.items():
            for w, i in words.items():
                names[i], langs[i] = w, lang
        ids = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        ends = np.array([words[_MARK] for words in self.number.values() if _MARK in words], np.int64)
        ids[np.isin(ids, ends)] = -1
        return names, langs, ids


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[str], np.ndarray]]:
    shard = _Shard()
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
            shard.add(lang.as_py(), text.as_py() or b"")
            if shard.size >= SHARD_WORDS:
                yield shard.closed()
                shard = _Shard()
    if shard.size:
        yield shard.closed()


def _word_keys(names: list[bytes], langs: list[str]) -> np.ndarray:
    """64 bits of each word in its language; equal to Spark's xxhash64(lang, word)."""
    seeds = {lang: xxhash.xxh64_intdigest(lang.encode(), 42) for lang in set(langs)}
    return np.fromiter((xxhash.xxh64_intdigest(w, seeds[lang]) for w, lang in zip(names, langs, strict=True)), np.uint64, len(names))


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = first * _MIX
    x = (x ^ (x >> np.uint64(29))) + second
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def _in(filter_bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _bitmap(keys: DataFrame) -> Broadcast:
    """The bits of all keys (column ``key``): a bitmap of ``FILTER_BITS`` bits, made of blocks of 4 KB that Spark aggregates."""
    spark = keys.sparkSession
    place = (F.shiftrightunsigned("key", 64 - FILTER_BITS) + 1).alias("at")  # counted from one
    blocks = keys.select(place).groupBy(F.bitmap_bucket_number("at").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    found = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in blocks.collect():  # 4,096 blocks of 4 KB at most
        start = (r["block"] - 1) * 4096
        found[start : start + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return spark.sparkContext.broadcast(found)


def _frequent(names: list[bytes], langs: list[str], ids: np.ndarray, words: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """The places of the shard with rare words taken for ends of pieces, and the words' keys."""
    keys = _word_keys(names, langs)
    keep = _in(words.value, keys)
    return np.where((ids >= 0) & keep[np.maximum(ids, 0)], ids, -1), keys


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, occurrences), and a null word with the number of all."""
    for names, langs, ids in _shards(batches):
        places = np.bincount(ids[ids >= 0], minlength=len(names))
        there = np.flatnonzero(places)
        totals: dict[str, int] = defaultdict(int)
        for i in there.tolist():
            totals[langs[i]] += int(places[i])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([langs[i] for i in there.tolist()] + list(totals), pa.string()),
                pa.array([names[i] for i in there.tolist()] + [None] * len(totals), pa.binary()).cast(pa.string()),
                pa.array(places[there].tolist() + list(totals.values()), pa.int64()),
            ],
            ["lang", "phrase", "n"],
        )


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """How often each phrase of up to ``depth`` words occurs (lang, phrase, size, n), if ``least`` times or more, and each language's number of words (lang, n)."""
    spark = shipped(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    every = staged(_sums(source.mapInArrow(tidy(_counted_words), "lang string, phrase string, n long"), "lang", "phrase").where((F.col("n") >= least) | F.col("phrase").isNull()), "words")
    words = every.where(F.col("phrase").isNotNull())
    word_bits = _bitmap(words.select(F.xxhash64("lang", "phrase").alias("key")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, langs, ids in _shards(batches):
            ids, keys = _frequent(names, langs, ids, word_bits)
            found = automaton(ids, 2)
            two = found.end[found.longest == 2]
            at = _pair_keys(keys[ids[two - 1]], keys[ids[two]])
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(found.places[found.longest == 2])], ["key", "n"])

    pair_keys = staged(_sums(source.mapInArrow(tidy(pairs), "key long, n long"), "key").where(F.col("n") >= least).select("key"), "pairs")
    pair_bits = _bitmap(pair_keys)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, langs, ids in _shards(batches):
            ids, keys = _frequent(names, langs, ids, word_bits)
            before = np.concatenate([[-1], ids[:-1]])
            both = np.flatnonzero((ids >= 0) & (before >= 0))
            pair = np.zeros(len(ids), bool)
            pair[both] = _in(pair_bits.value, _pair_keys(keys[before[both]], keys[ids[both]]))
            found = automaton(ids, depth, pair)
            for at in range(0, len(found.end), 1 << 16):
                some = np.flatnonzero(found.longest[at : at + (1 << 16)] > 1) + at
                ends, sizes = found.end[some].tolist(), found.longest[some].tolist()
                longest = [[names[w] for w in ids[e - k + 1 : e + 1].tolist()] for e, k in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([langs[ids[e]] for e in ends], pa.string()), pa.array(longest, pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(found.shortest[some], pa.int32()), pa.array(found.places[some])],
                    ["lang", "longest", "shortest", "n"],
                )

    states = source.mapInArrow(tidy(phrases), "lang string, longest array<string>, shortest int, n long")
    # a state's phrases are the suffixes of its longest
    sizes = F.explode(F.sequence(F.greatest("shortest", F.lit(2)), F.size("longest"))).alias("size")
    spelt = states.select("lang", "longest", "n", sizes).select("lang", F.array_join(F.slice("longest", -F.col("size"), F.col("size")), " ").alias("phrase"), "size", "n")
    several = _sums(spelt, "lang", "phrase", "size").where(F.col("n") >= least)
    counts = words.select("lang", "phrase", F.lit(1).alias("size"), "n").unionByName(several)
    return staged(counts, "phrases"), every.where(F.col("phrase").isNull()).select("lang", "n")


def collocations(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, depth: int = DEPTH, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """The phrases of two words or more that belong together, ``top`` of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase occurs ``a`` times; its weakest cut, the first of equals, leaves
    parts that occur ``l`` and ``r`` times, and gives the score 2,000,000 a / (l +
    r), rounded down.  Phrases most of whose occurrences (``subsumed``
    hundredths) lie in one longer phrase are left out.

    A null text has no words, a null language is ``und``; a row that stands
    twice counts twice; ids and other columns play no part.  Ties in score and
    count are ordered by the phrases' bytes.  An empty table, or one without
    frequent phrases, gives an empty one.
    """
    counts, totals = phrase_counts(docs, lang_col=lang_col, text_col=text_col, least=least, depth=depth)
    candidates = counts.where(F.col("size") > 1).select("lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    joined = lambda start, length: F.array_join(F.slice("words", start, length), " ")

    cuts = candidates.select("lang", "phrase", "a", "size", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), joined(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit(1).alias("side"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("part"))))
    parts = staged(cuts.select("lang", F.col("phrase").alias("whole"), "a", "k", sides.alias("x")).select("lang", "whole", "a", "k", "x.side", F.col("x.part").alias("phrase")), "parts")
    met = split_join(parts, counts.select("lang", "phrase", "n"), ["lang", "phrase"])
    cut = met.groupBy("lang", "whole", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    scored = cut.withColumns({"x": F.lit(2_000_000).cast("decimal(7,0)") * exact("a"), "y": exact("l") + exact("r")}).withColumn("score", F.expr("x div y"))
    weakest = scored.groupBy("lang", F.col("whole").alias("phrase"), "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))

    shorter = F.explode(F.array(joined(F.lit(2), F.col("size") - 1), joined(F.lit(1), F.col("size") - 1))).alias("phrase")
    held = candidates.where(F.col("size") > 2).select("lang", shorter, "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    alone = weakest.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * exact("most") < subsumed * exact("a")))

    order = [F.desc("x.score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANKED_IN)).alias("part")
    some = alone.select("lang", "phrase", "a", "x", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest phrases of each language."""
    return staged_alone(lambda: collocations(table(spark, sf_dir, "documents")), "collocations")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  {" UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM worded WHERE len(w) >= {k}" for k in range(1, DEPTH + 1))}
), counted AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size >= 2 AND f >= {LEAST}
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, h.f AS l, t.f AS r, (2000000::HUGEINT * c.a) // (h.f::HUGEINT + t.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counted h ON h.lang = c.lang AND h.phrase = array_to_string(c.w[1:k], ' ') AND h.size = k
  JOIN counted t ON t.lang = c.lang AND t.phrase = array_to_string(c.w[k + 1:], ' ') AND t.size = c.size - k
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a AS longer
  FROM (SELECT *, unnest(range(1, size - s + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS s FROM candidates))
), alone AS (
  SELECT * FROM weakest x WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = x.lang AND i.phrase = x.phrase AND 100::HUGEINT * i.longer >= {SUBSUMED}::HUGEINT * x.a)
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone) JOIN totals USING (lang)
WHERE rank <= {TOP}
"""
