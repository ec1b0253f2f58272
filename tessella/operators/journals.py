"""Journals: what tasks were told, written as it comes, so that nothing is asked twice."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "key string, results string, final boolean"


def answered(spark: SparkSession, folder: str) -> DataFrame:
    """All entries of a journal: key, results (as JSON) and whether they are final; none if the folder isn't there."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "*.jsonl").json(folder)


def fill(rows: DataFrame, answer: Callable[[list[dict]], list[tuple[str, list, bool]]], folder: str, at_a_time: int) -> int:
    """Have each row answered and write the answers, ``at_a_time`` rows to a file; how many there were.

    ``answer`` takes rows and gives (key, results, final) for each.  A file is
    written under another name and moved when it is whole; what a lost task had
    written stays, and its rows are dropped from what the next attempt asks only
    by a later run, so an entry may stand twice.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(root)
        for frame in frames:
            every = frame.to_dict("records")
            for at in range(0, len(every), at_a_time):
                found = answer(every[at : at + at_a_time])
                name = f"{root.rstrip('/')}/{uuid.uuid4().hex}.jsonl"
                with store.open_output_stream(f"{name}.part") as out:
                    out.write("".join(json.dumps({"key": k, "results": json.dumps(r, ensure_ascii=False), "final": f}, ensure_ascii=False) + "\n" for k, r, f in found).encode())
                store.move(f"{name}.part", name)
                yield pd.DataFrame({"n": [len(found)]})

    return rows.mapInPandas(run, "n bigint").agg({"n": "sum"}).first()[0] or 0
