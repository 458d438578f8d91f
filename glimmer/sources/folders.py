"""A source that lists media files: ``spark.read.format("media_folder").load(path)``, one task for each folder below the path.

The driver lists one level; the tasks list what lies below, so a large tree is listed by many. Contents are not read. Options: ``path``;
``recursive`` (true); ``types`` (names of EXTENSIONS, separated by commas; all); ``extensions`` (own ones, separated by commas, of type
'other'). Paths are local ones that driver and executors share, or of a store that pyarrow reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glimmer.operators import jobs
from glimmer.session import ship_package
from glimmer.sources.catalog import IMAGES, VIDEOS

EXTENSIONS = {"image": IMAGES, "video": VIDEOS}
COLUMNS = "path string, type string, length long, modified long"
#: Files in a batch.
BATCH = 10_000


@dataclass
class Folder(InputPartition):
    path: str
    recursive: bool


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        split = lambda name: [x.strip().lower() for x in options.get(name, "").split(",") if x.strip()]
        self.kinds = {e: kind for kind in split("types") or EXTENSIONS for e in EXTENSIONS[kind]}
        if split("extensions"):
            self.kinds = dict.fromkeys(split("extensions"), "other")

    def partitions(self) -> list[Folder]:
        """The folder's own files, and each folder in it."""
        store, path = opened(self.path)
        below = [x.path for x in store.get_file_info(fs.FileSelector(path)) if x.type == fs.FileType.Directory] if self.recursive else []
        return [Folder(path, False), *(Folder(p, True) for p in sorted(below))]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        rows = []
        for x in store.get_file_info(fs.FileSelector(partition.path, recursive=partition.recursive)):
            kind = self.kinds.get(x.extension.lower())
            if x.type == fs.FileType.File and kind:
                rows.append((x.path, kind, x.size, int(x.mtime_ns // 1_000_000)))
        for a in range(0, len(rows), BATCH):
            path, kind, size, at = zip(*rows[a : a + BATCH], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(kind), pa.array(size, pa.int64()), pa.array(at, pa.int64())], ["path", "type", "length", "modified"])


class MediaFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_folder"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def read_folder(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path, type, length, modified (milliseconds) of the files below ``path``."""
    ship_package(spark)
    spark.dataSource.register(MediaFolder)
    return spark.read.format("media_folder").options(**options).load(path)


def enqueue(spark: SparkSession, path: str, known: DataFrame, number: int = 1, **options: str) -> DataFrame:
    """(path, pass, id, created): a job for each file found; one that is active for its path and pass is taken again."""
    return jobs.create_jobs(read_folder(spark, path, **options).select("path", F.lit(number).alias("pass")), known)
