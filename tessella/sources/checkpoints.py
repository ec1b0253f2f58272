"""The folder that driver and executors share, and tables kept there between stages."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in ``spark.checkpoint.dir``; a temporary folder only where that is unset and all tasks run on this machine."""
    folder, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = sc._tessella_folder = getattr(sc, "_tessella_folder", None) or tempfile.mkdtemp(prefix="tessella-")
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/tessella/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(target)  # only what is there can be marked
    store.deleteOnExit(target)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends here, and nothing above runs twice.  It goes when the driver ends."""
    path = scratch(df.sparkSession, label)
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to Python workers through Spark's file server, once for each context."""
    root = Path(__file__).resolve().parent.parent
    files = sorted(root.rglob("*.py"))
    mark = hashlib.sha256(b"".join(f.read_bytes() for f in files)).hexdigest()[:16]
    if getattr(spark.sparkContext, "_tessella_shipped", None) != mark:
        path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), f"tessella-{mark}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in files:
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(path)
        spark.sparkContext._tessella_shipped = mark
    return spark
