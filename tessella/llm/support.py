"""What the operators of this subpackage share: tables and the shared folder."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch that is passed to Python.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset
    and all tasks run on this machine, as in local tests, is a temporary folder
    made, once for each context; on a cluster an unset folder is an error, as
    each machine would write to its own disk.
    """
    folder, sc = spark.conf.get(CHECKPOINT_KEY, None), spark.sparkContext
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        folder = sc._tessella_folder = getattr(sc, "_tessella_folder", None) or tempfile.mkdtemp(prefix="tessella-")
    return folder.rstrip("/")


class _Written(threading.local):
    """The tables that a thread has written to the shared folder and not deleted since."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_written = _Written()


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage and survives lost executors: later jobs reread the files
    rather than recompute, and any executor can read them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessella/{label}-{uuid.uuid4().hex}"
    _written.paths.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    if path in _written.paths:
        _written.paths.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing to come reads; any other table is left alone."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            _delete(df.sparkSession, path)


def staged_alone(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """Write what ``make`` returns, then delete every table that was staged on the way to it."""
    before = set(_written.paths)
    out = staged(make(), label)
    for path in [p for p in _written.paths if p not in before and p != out._staged_at]:
        _delete(out.sparkSession, path)
    return out


def smallest(df: DataFrame, hashed_by: Column, bound: int, *ties: str) -> DataFrame:
    """The ``bound`` rows with the smallest hashes (64 bits), in their order and that of ``ties``.

    Each task would send as many rows as the bound; so rows with larger hashes
    than about twice the bound's share are left out before, if enough remain.
    ``df`` is read more than once.
    """
    rows = df.count()
    if rows > 2 * bound:
        some = df.where(hashed_by < F.lit(int(-(1 << 63) + (1 << 64) * (2 * bound / rows))))
        df = some if some.count() >= bound else df
    return df.orderBy(hashed_by, *ties).limit(bound)


#: Bytes of a hashed side that one task may hold.
HASHED_BYTES = 64 << 20


def hashed(df: DataFrame, size: int) -> DataFrame:
    """The side of a join with the hint to hash it, which spares sorting the other side, if its bytes for each task are few; a map can't spill, a sort can."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.hint("shuffle_hash") if size <= tasks * HASHED_BYTES else df


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_keys: int = 2_000) -> DataFrame:
    """Join ``left`` to ``right``, which has each key once, so that no key's rows meet in one task.

    Keys with more than 1/``hot_keys`` of all rows of ``left`` are ``hot_keys``
    at most, as their rows add up to all; their rows of ``right`` are broadcast,
    the others are dealt out by key.  ``left`` is read more than once and should
    be staged.  ``how`` is inner or left_semi.
    """
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    bound = max(1_000, left.count() // hot_keys)
    often = staged(right.join(F.broadcast(counts.where(F.col("_n") > bound).select(*on)), on, "left_semi"), "often")
    seldom = left.join(F.broadcast(often.select(*on)), on, "left_anti").join(right.join(F.broadcast(often.select(*on)), on, "left_anti"), on, how)
    return left.join(F.broadcast(often), on, how).unionByName(seldom)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Dense numbers from 0 in an order (column ``number``), without one task seeing all rows.

    Rows are sorted over ranges and staged with their range and their place in
    it, as a second sample might cut the ranges otherwise; the ranges' sizes give
    the offsets.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed = staged(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "numbered")
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each range
    starts = [sum(sizes.get(j, 0) for j in range(i)) for i in range(tasks)]
    return placed.withColumn("number", F.col("_place") + F.get(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("_part"))).drop("_part", "_place")


def shipped(spark: SparkSession) -> SparkSession:
    """Make a session ready for this package's Python workers.

    The package is sent once for each context: executors may not have it
    installed, and Spark's file server hands the archive out, so nothing depends
    on the driver's folders.  Batches of ``BATCH_ROWS`` rows replace Spark's
    default of 10,000, which whole texts make tens of megabytes each, held
    several times over by both sides of a task; a setting of the session's own
    is left alone.
    """
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    root = Path(__file__).resolve().parent.parent
    files = sorted(root.rglob("*.py"))
    mark = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", None) != mark:
        path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), f"tessella-{mark}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in files:
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(path)
        sc._tessella_shipped = mark
    return spark


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """Give freed memory back to the system after a task: its worker stays, idle, while others need the room."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library that has it
            if trim:
                trim(0)

    return wrapped
