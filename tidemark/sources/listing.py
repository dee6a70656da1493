"""Files of a folder as a table, with size and time, and the contents of named files.

Folders are opened by pyarrow's file systems (local and mounted paths, s3, gs, hdfs), so files of zero bytes are listed,
which Spark's own readers leave out. For a store that only Spark opens, ``spark_listing`` and ``files.read_texts`` remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, modified_ns long"
#: Folders that are looked for, level by level, before files are listed; each is listed by a task of its own.
FOLDERS = 256


def opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system, the path in it, and what goes before such a path to give a full one."""
    store, path = fs.FileSystem.from_uri(root)
    path = path.rstrip("/") or "/"
    full = root.rstrip("/") or "/"
    return store, path, full[: -len(path)] if full.endswith(path) else ""


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        super().__init__(path)
        self.path, self.deep = path, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, folders: int):
        self.root, self.folders = root, folders

    def partitions(self) -> list[InputPartition]:
        """The folders of the upper levels, of which the last found are listed with all below them."""
        store, path, _ = opened(self.root)
        above: list[str] = []
        level = [path]
        while 0 < len(level) and len(above) + len(level) < self.folders:
            below = [x.path for p in level for x in store.get_file_info(fs.FileSelector(p)) if x.type == fs.FileType.Directory]
            above += level
            level = below
        return [_Folder(p, False) for p in above] + [_Folder(p, True) for p in level]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _, before = opened(self.root)
        names = ["path", "size", "modified_ns"]
        for x in store.get_file_info(fs.FileSelector(partition.path, recursive=partition.deep)):
            if x.type == fs.FileType.File:
                yield pa.RecordBatch.from_arrays([pa.array([before + x.path]), pa.array([x.size], pa.int64()), pa.array([x.mtime_ns], pa.int64())], names=names)


class FileListing(DataSource):
    """Option ``path``: the folder. Option ``folders``: about how many tasks list it."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("folders", FOLDERS)))


def list_files(spark: SparkSession, root: str, folders: int = FOLDERS) -> DataFrame:
    """path, size (bytes) and modified_ns of every file under ``root``, files of zero bytes included. A missing folder is an error."""
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").option("folders", folders).load(root)


def spark_listing(spark: SparkSession, root: str) -> DataFrame:
    """The same from Spark's reader of binary files, which leaves out files of zero bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.selectExpr("path", "length AS size", "unix_micros(modificationTime) * 1000 AS modified_ns")


def contents(df: DataFrame, path: str, out: str = "content") -> DataFrame:
    """``df`` with the bytes of the file that the column ``path`` names; null where it is null or no such file is there.

    Each task opens its own rows' files, one at a time; nothing is listed.
    """
    schema = T.StructType([*df.schema, T.StructField(out, T.BinaryType())])
    at = df.columns.index(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, fs.FileSystem] = {}

        def read(full: str | None) -> bytes | None:
            if full is None:
                return None
            scheme, sep, rest = full.partition("://")
            host = scheme + sep + rest.partition("/")[0] if sep else ""
            if host not in stores:
                stores[host] = fs.FileSystem.from_uri(full)[0]
            try:
                with stores[host].open_input_stream(fs.FileSystem.from_uri(full)[1]) as f:
                    return f.read()
            except FileNotFoundError:
                return None

        for batch in batches:
            for i in range(batch.num_rows):  # files may be large, so a row is a batch
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([read(row.column(at)[0].as_py())], pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)
