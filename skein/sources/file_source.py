"""Files as a data source of Spark: spark.read.format("skein_files"). What its options rule out is settled by the listing: such files are never opened and skipped folders not even listed.

    spark.dataSource.register(FileSource)
    spark.read.format("skein_files").option("extensions", "py,v").option("mostBytes", 500000).load("/shared/code")

Options: extensions (in any case, separated by commas), leastBytes, mostBytes, skip (names of folders not gone into, separated by commas), recursive (default true), partBytes (bytes of files of a partition,
default 64 MB). The path is one of any file system that pyarrow knows; a plain path is one of a mount that all machines share. A partition is a list of files, so a lost executor's files are read again elsewhere.

These are options and not filters that Spark pushes down: Spark 4.1 keeps what one query pushed into a relation for the next query of the same relation that pushes nothing, which then lacks rows (tested).
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PART_BYTES, BATCH_BYTES = 64 << 20, 16 << 20
SCHEMA = "path string, folder string, name string, extension string, length long, content binary"
LISTED = ("path", "folder", "name", "extension", "length")


@dataclass
class Part(InputPartition):
    files: list[tuple[str, int]]


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(path: str, size: int) -> dict:
    folder, name = posixpath.split(path)
    stem, dot, extension = name.rpartition(".")
    return {"path": path, "folder": folder, "name": name, "extension": extension.lower() if dot and extension.isalnum() and extension.isascii() else "", "length": size}


def _list(options: dict, name: str) -> set[str]:
    return {x.strip() for x in options.get(name, "").split(",")} - {""}


class FileReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.skip, self.extensions = options["path"].rstrip("/") or "/", _list(options, "skip"), {x.lower() for x in _list(options, "extensions")}
        self.recursive, self.part_bytes = str(options.get("recursive", "true")).lower() == "true", int(options.get("partbytes", PART_BYTES))
        self.least, self.most = int(options.get("leastbytes", 0)), int(options.get("mostbytes", (1 << 63) - 1))

    def wanted(self, path: str, size: int) -> bool:
        return self.least <= size <= self.most and (not self.extensions or _listed(path, size)["extension"] in self.extensions)

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        system, root = _opened(self.path)
        found, folders = [], [root]
        while folders:
            for entry in system.get_file_info(fs.FileSelector(folders.pop(), recursive=False)):
                if entry.type == fs.FileType.Directory:
                    if self.recursive and entry.base_name not in self.skip:
                        folders.append(entry.path)
                elif entry.type == fs.FileType.File and self.wanted(entry.path, entry.size):
                    found.append((entry.path, entry.size))
        parts, held = [], 0
        for path, size in sorted(found):
            if not parts or held + size > self.part_bytes:
                parts.append(Part([]))
                held = 0
            parts[-1].files.append((path, size))
            held += size
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        rows, held = [], 0
        for path, size in partition.files:
            with system.open_input_stream(path) as f:
                rows.append({**_listed(path, size), "content": f.read()})
            held += size
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([*((c, pa.string()) for c in LISTED[:-1]), ("length", pa.int64()), ("content", pa.binary())]))


class FileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(dict(self.options))


def listed_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = (), most_bytes: int | None = None, skip: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """The files below a folder (path, folder, name, extension in lower case, length, content): of some extensions and up to a size, if told. An empty folder gives no rows, a missing one is an error."""
    spark.dataSource.register(FileSource)
    r = spark.read.format("skein_files").option("extensions", ",".join(extensions)).option("skip", ",".join(skip)).option("recursive", str(recursive).lower())
    return (r if most_bytes is None else r.option("mostBytes", most_bytes)).load(path)
