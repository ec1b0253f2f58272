"""A sink for files: all that a job writes appears when it commits, and nothing of it if it fails."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .checkpoints import shipped


def _store(folder: str):
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    return store, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: where each waits, and where it belongs."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    """Tasks write to a folder of the job's own; the commit moves what the tasks report, an abort deletes the folder."""

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.folder)
        attempt, files = f"{root}/_pending/{self.job}/{uuid.uuid4().hex}", []
        for row in rows:
            target, pending = f"{root}/{row['path']}", f"{attempt}/{len(files)}"
            if not files:
                store.create_dir(attempt)
            with store.open_output_stream(pending) as out:
                out.write(bytes(row["content"]))
            files.append((pending, target))
        return Written(files)

    def commit(self, messages: list) -> None:
        store, root = _store(self.folder)
        files = [f for m in messages if m is not None for f in m.files]
        for folder in {t.rpartition("/")[0] for _, t in files}:
            store.create_dir(folder)
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: store.move(*f), files))
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.folder))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/_pending/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_pending/{self.job}")
        if not store.get_file_info(fs.FileSelector(f"{root}/_pending", allow_not_found=True)):
            if store.get_file_info(f"{root}/_pending").type == fs.FileType.Directory:
                store.delete_dir(f"{root}/_pending")


class Files(DataSource):
    """``df.write.format("files")``: a file for each row (path, content) under the folder of the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, folder: str) -> None:
    """K6, K7: files (path, content) under a folder, all of them or none."""
    spark = shipped(files.sparkSession)
    spark.dataSource.register(Files)
    files.select("path", F.col("content").cast("binary").alias("content")).write.format("files").mode("append").save(folder)


def sidecar_files(collages: DataFrame) -> DataFrame:
    """K7: a JSON document for each collage, beside its image."""
    number = F.col("collage_index").cast("string")
    shard = F.floor(F.col("collage_index") / 1000).cast("string")
    return collages.select(F.concat(F.lit("images/"), shard, F.lit("/"), number, F.lit(".json")).alias("path"), F.to_json(F.struct("canvas", "layouts")).cast("binary").alias("content"))
