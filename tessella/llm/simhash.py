"""Near-duplicate groups from 64-bit SimHash fingerprints, found through Golay codewords.

Two fingerprints that differ in four bits or fewer are linked.  To find all such
pairs without comparing all pairs, a fingerprint is cut into segments A and B of
23 bits and C of 18.  The binary Golay code (23, 12) gives each 23-bit segment
the numbers of all codewords within distance 4: one number, or six.  Segments
that differ in two bits or fewer always share a number.  By the pigeonhole
principle, errors (a, b, c) in the segments leave one of these keys equal:

* c = 0: a number of A, or of B, with all of C;
* a = 0 or b = 0: that segment with a number of the other, or (three errors in
  the other, one in C) with a half of C;
* (1, 1 or 2, 1): a half of A, a number of B and a half of C; (2, 1, 1) likewise;
* (1, 1, 2): a half of A, a half of B and a third of C.

A key has 29 bits at least, so that a pair of unlike fingerprints meets with a
probability of about 1e-7.

Buckets of equal keys are not expanded into pairs.  Each bucket first links its
members to three of it (the smallest, the largest, and one that a hash chooses)
where they are within four bits; components of these links absorb dense groups.
Only members outside of the largest component of a bucket are then compared with
the rest of the bucket, and the comparison is the join's own condition.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .support import discard, hashed, shipped, split_join, staged, staged_alone, table, tidy

#: Words of a shingle, the seed of its hash, and the bits in which linked fingerprints may differ.
WORDS, SEED, BITS = 4, 42, 4
#: Distinct fingerprints whose keys one task makes, and members of a bucket that one task compares, about.
KEYED_ROWS, BUCKET_ROWS = 20_000, 4_000
#: Fixed value: the generator polynomial of the binary Golay code (23, 12).
GENERATOR = 0xC75


def fingerprint(text: bytes) -> int:
    """The SimHash of a text: a bit is set if more than half of the shingles' hashes have it."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist(), strict=True)])
    n = len(hashes) // 8
    counts = np.zeros(64, np.int64)
    grid = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(grid[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the fingerprint as a signed long) of every whole text; null counts as empty."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint((t.as_py() or "").encode()) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return source.mapInArrow(tidy(run), T.StructType([source.schema["id"], T.StructField("fp", T.LongType())]))


def _remainder(v: int) -> int:
    for i in range(22, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


class Golay:
    """Numbers of the codewords within distance 4 of 23-bit values."""

    def __init__(self) -> None:
        single = [_remainder(1 << i) for i in range(23)]
        near: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(5):
            for places in combinations(range(23), weight):
                remainder = 0
                for p in places:
                    remainder ^= single[p]
                if not near[remainder] or (weight == 4 and near[remainder][0].bit_count() == 3):
                    near[remainder].append(sum(1 << p for p in places))
        self.count = np.array([len(x) for x in near])
        self.errors = np.array([x + x[:1] * (6 - len(x)) for x in near], np.int64)
        parts = [np.zeros(256, np.int64) for _ in range(3)]
        for k, part in enumerate(parts):
            for v in range(256):
                for i in range(8):
                    if v >> i & 1 and 8 * k + i < 23:
                        part[v] ^= single[8 * k + i]
        self.parts = parts

    def numbers(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Six numbers for each value, and how many of them differ (the others repeat the first)."""
        remainder = self.parts[0][v & 255] ^ self.parts[1][v >> 8 & 255] ^ self.parts[2][v >> 16]
        return (v[:, None] ^ self.errors[remainder]) >> 11, self.count[remainder]


_golay: list[Golay] = []


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each fingerprint (unsigned), and the place of the fingerprint that each key belongs to."""
    if not _golay:
        _golay.append(Golay())
    v = fps.astype(np.uint64)
    a, b, c = ((v >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    (na, ca), (nb, cb) = _golay[0].numbers(a), _golay[0].numbers(b)
    six = np.arange(6)
    keys, places = [], []
    here = np.arange(len(v))

    def add(*parts: tuple[int, np.ndarray, np.ndarray | None]) -> None:
        """A kind of key: parts of (bits, values by alternative, which alternatives count)."""
        total, counts = np.zeros((len(v), 1), np.int64), np.ones((len(v), 1), bool)
        for bits, values, real in parts:
            values = values.reshape(len(v), -1)
            real = np.ones(values.shape, bool) if real is None else real
            total = (total[:, :, None] << bits | values[:, None, :]).reshape(len(v), -1)
            counts = (counts[:, :, None] & real[:, None, :]).reshape(len(v), -1)
        keys.append((total | len(keys) << 58)[counts])
        places.append(np.broadcast_to(here[:, None], total.shape)[counts])

    def pieces(x: np.ndarray, *cuts: int) -> np.ndarray:
        """The pieces of x between the cuts, each told apart by its place."""
        return np.stack([x >> low & ((1 << high - low) - 1) | i << 12 for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False))], axis=1)

    golay_a, golay_b = (12, na, six < ca[:, None]), (12, nb, six < cb[:, None])
    half_a, half_b, half_c, third_c = (13, pieces(a, 0, 11, 23), None), (13, pieces(b, 0, 11, 23), None), (13, pieces(c, 0, 9, 18), None), (14, pieces(c, 0, 6, 12, 18), None)
    add(golay_a, (18, c, None))
    add(golay_b, (18, c, None))
    add((23, a, None), golay_b)
    add(golay_a, (23, b, None))
    add((23, a, None), half_c)
    add((23, b, None), half_c)
    add(half_a, golay_b, half_c)
    add(golay_a, half_b, half_c)
    add(half_a, half_b, third_c)
    return np.concatenate(keys), np.concatenate(places)


def _keyed(distinct: DataFrame) -> DataFrame:
    """A row (key, fp) for each key of each distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fps), 4_000):
                keys, places = bucket_keys(fps[at : at + 4_000].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at : at + 4_000][places])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(tidy(run), "key long, fp long")


def _within(x: str, y: str) -> F.Column:
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= BITS


def linked(distinct: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every fingerprint that links to another, from the distinct ones (column fp).

    A fingerprint gives some eighty keys, so the few files of ``distinct`` are
    first dealt to tasks of ``KEYED_ROWS`` at most.  The keys are made once and
    staged.
    """
    spark = distinct.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-distinct.count() // KEYED_ROWS))
    keyed = staged(_keyed(distinct.repartition(tasks, "fp")), "keyed")
    buckets = keyed.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last"), F.min_by("fp", F.xxhash64("fp")).alias("some")).where(F.col("first") != F.col("last"))
    shared = staged(keyed.join(buckets, "key"), "shared")
    discard(keyed)
    near = F.explode(F.filter(F.array_distinct(F.array("first", "last", "some")), lambda x: (x != F.col("fp")) & (F.bit_count(x.bitwiseXOR(F.col("fp"))) <= BITS)))
    close = shared.select(F.col("fp").alias("a"), near.alias("b"))
    roots = staged(components(close, "dense"), "roots")
    named = shared.join(roots, shared["fp"] == roots["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "named")
    bridges = staged(_bridges(named), "bridges")
    outer = components(bridges, "bridges")
    named_roots = roots.join(outer.select(F.col("node").alias("root"), F.col("root").alias("outer")), "root", "left").select("node", F.coalesce("outer", "root").alias("root"))
    alone = outer.join(roots, "node", "left_anti")
    discard(shared, named, bridges)
    return named_roots.unionByName(alone)


def _bridges(named: DataFrame) -> DataFrame:
    """Pairs (a, b) of roots that close members of one bucket join; each pair of roots comes once from a task.

    Only members outside of a bucket's largest component are compared with the
    others.  Both sides of a large bucket are cut into parts of about
    ``BUCKET_ROWS``, and each part of one side meets each of the other, so a task
    holds two parts at a time, however large the bucket and its components are.
    """
    count = lambda rows: F.ceil(F.col(rows) / BUCKET_ROWS).cast("int")
    main = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("outside")).where("roots > 1")
    met = staged(named.join(main.select("key", "main", count("all").alias("parts"), count("outside").alias("parts2")), "key"), "met")
    own = lambda parts: F.pmod(F.xxhash64("fp"), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    members = met.select("key", own("parts").alias("part"), each("parts2").alias("part2"), "fp", "root")
    others = met.where(F.col("root") != F.col("main")).select("key", each("parts").alias("part"), own("parts2").alias("part2"), F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    close = members.join(others, ["key", "part", "part2"]).where((F.col("root") != F.col("root2")) & _within("fp", "fp2"))
    return close.select(F.greatest("root", "root2").alias("a"), F.least("root", "root2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The group of every document: rows (id_col, ``fingerprint``, ``component_id``).

    ``component_id`` is the smallest id that can be reached over links, the
    document's own included.  Equal texts have equal fingerprints and meet as
    one; only distinct fingerprints are keyed and compared.

    Defined cases: texts without words (null or empty too) have the fingerprint
    zero and link like any other; rows that repeat an id each get a row; null
    ids are never the smallest (a group of nothing else has a null component);
    other columns may have any names; an empty table gives an empty result.
    """

    def found() -> DataFrame:
        every = staged(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
        distinct = staged(every.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
        roots = staged(linked(distinct.select("fp")), "links")
        rooted = staged(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
        # a component, or a fingerprint, that a large share has doesn't meet in one task
        groups = split_join(rooted, rooted.groupBy("root").agg(F.min("least").alias("component_id")), ["root"]).select("fp", "component_id")
        return split_join(every, groups, ["fp"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

    return staged_alone(found, "groups")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group, with the columns it came with; rows that repeat that id are one document and all stay; rows with a null id can't be told apart, so all stay if one does."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    stays = F.bool_or(F.col(id_col).eqNullSafe(F.col("component_id")))
    lost = found.groupBy(F.col(id_col).alias("_lost_id")).agg(stays.alias("stays")).where(~F.col("stays")).select("_lost_id")
    lost = staged(lost, "lost")
    return docs.join(hashed(lost, 64 * lost.count()), docs[f"`{id_col}`"].eqNullSafe(lost["_lost_id"]), "left_anti")


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id of its near-duplicate group."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
