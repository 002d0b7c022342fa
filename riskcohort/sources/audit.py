"""Audit of landed files of any size: a Python data source that reads them in pieces."""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 1 << 20
# Files are dealt out in groups of about this many bytes; a larger one is a task of its own.
GROUP = 128 << 20
NAME = "landed_files"
_SCHEMA = "path string, file string, bytes long, head binary, sha256 string"


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str]]) -> None:
        super().__init__(files)
        self.files = files


def _store(path: str):
    """File system and path of a URI or a local path."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.head = int(options.get("headbytes", "16"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = _store(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path))
        files = sorted((f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)),
                       key=lambda f: f.path)
        groups: list[list[tuple[str, str]]] = []
        room = 0
        for f in files:
            if room <= 0:
                groups.append([])
                room = GROUP
            groups[-1].append((f.path, f.base_name))
            room -= f.size
        return [_Files(g) for g in groups or [[]]]

    def read(self, partition: _Files) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path, name in partition.files:
            digest, total, head = hashlib.sha256(), 0, b""
            with store.open_input_stream(path) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
                    total += len(piece)
                    if len(head) < self.head:
                        head = (head + piece)[:self.head]
            yield path, name, total, head, digest.hexdigest()


class LandedFiles(DataSource):
    """``path, file, bytes, head, sha256`` of the files of a folder (option ``pattern``), or of one file.

    The driver lists names; a task reads its files one after the other, a piece at a time, and never holds one whole.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def landed_files(spark: SparkSession, path: str, pattern: str = "*", head_bytes: int = 16) -> DataFrame:
    spark.dataSource.register(LandedFiles)
    return spark.read.format(NAME).option("pattern", pattern).option("headbytes", str(head_bytes)).load(path)
