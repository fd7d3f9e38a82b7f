"""A data source that lists files: a partition is some folders, and folders that are excluded are never opened.

``spark.read.format("quarry_folders").load(path)`` has path, length and modified (seconds). Options: recursive, extensions and exclude (JSON lists), most_bytes (0: any
size). Folders are walked where the query is planned; their files are looked at by the tasks. A folder that can't be opened is told and left
out. Paths are those that pyarrow's file systems reach.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.paths import excluded

#: Folders of one partition.
TOGETHER = 64


def opened(files: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What lies in a folder; nothing, and a word about it, if it can't be opened. Names that begin with a dot or an underscore are left out, as Spark's readers do."""
    try:
        return [f for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name[:1] not in "._"]
    except OSError as e:
        logging.getLogger(__name__).warning("%s can't be listed and is left out: %s", folder, e)
        return []


def walk(files: fs.FileSystem, root: str, recursive: bool, exclude: Sequence[str]) -> Iterator[str]:
    """The folders from ``root`` on, without those that are excluded and what is below them."""
    parts = root.rstrip("/").split("/")
    if any(excluded("/".join(parts[:i]) + "/", exclude) for i in range(2, len(parts) + 1)):
        return
    waiting = [root.rstrip("/") or "/"]
    while waiting:
        folder = waiting.pop()
        yield folder
        if recursive:
            waiting += [f.path for f in opened(files, folder) if f.type == fs.FileType.Directory and not excluded(f.path + "/", exclude)]


class Folders(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class FolderReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.root, self.recursive = options["path"], options.get("recursive", "true") == "true"
        self.extensions, self.exclude = (tuple(json.loads(options.get(k, "[]"))) for k in ("extensions", "exclude"))
        self.most = int(options.get("most_bytes", 0))

    def _files(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        files, root = self._files()
        if files.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        folders = list(walk(files, root, self.recursive, self.exclude))
        return [Folders(folders[i : i + TOGETHER]) for i in range(0, len(folders), TOGETHER)] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        files, _ = self._files()
        for folder in partition.paths:
            found = [
                f for f in opened(files, folder)
                if f.type == fs.FileType.File and (not self.most or f.size <= self.most) and (not self.extensions or f.path.endswith(self.extensions)) and not excluded(f.path, self.exclude)
            ]
            columns = [[f.path for f in found], [f.size for f in found], [f.mtime_ns // 1_000_000_000 for f in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "length", "modified"])


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry_folders"

    def schema(self) -> str:
        return "path string, length bigint, modified bigint"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def is_local(spark: SparkSession, path: str) -> bool:
    """Whether Spark takes a path for one of the local file system, which pyarrow then reaches, too."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() == "file"
