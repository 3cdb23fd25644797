"""Inventory of the files below some folders, listed by the executors.

Spark's own file sources leave out hidden and zero-byte files, which this
listing has to report, so the folders are walked inside tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCK_PREFIX = "~$"
LARGE_FILE = 100 * 1024 * 1024
_BATCH = 8192
_FILES = pa.schema([("file", pa.string()), ("length", pa.int64()), ("modified", pa.int64())])


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain local path."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def _list_folder(uri: str) -> tuple[list[str], list[tuple[str, int, int | None]]]:
    fs, path = filesystem(uri)
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    folders, files = [], []
    for info in fs.get_file_info(pafs.FileSelector(path, recursive=False)):
        if info.type == pafs.FileType.Directory:
            folders.append(prefix + info.path)
        elif info.type == pafs.FileType.File:
            files.append((prefix + info.path, info.size or 0, info.mtime_ns))
    return folders, files


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[str, int, int | None]] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*found), _FILES.types)]
        found.clear()
        return pa.record_batch(columns, schema=_FILES)

    for units in batches:
        for unit in units.to_pylist():
            todo = [unit["folder"]]
            while todo:
                folders, files = _list_folder(todo.pop())
                if unit["deep"]:
                    todo.extend(folders)
                found.extend(files)
                if len(found) >= _BATCH:
                    yield batch()
    if found:
        yield batch()


def list_files(
    spark: SparkSession, roots: Sequence[str], extension: str = ".xlsx", fan_out: int | None = None
) -> DataFrame:
    """Files below the roots by extension (any case), without lock files.

    Gives file, name, length, modified (nanoseconds, null where the storage has no time), audit
    ("empty", "large" or null). The driver opens
    folders only until it has ``fan_out`` of them to hand out; tasks walk those.
    """
    fan_out = fan_out or 4 * spark.sparkContext.defaultParallelism
    units: list[tuple[str, bool]] = []
    open_folders = [r.rstrip("/") or "/" for r in roots]
    while open_folders and len(units) + len(open_folders) < fan_out:
        folder = open_folders.pop(0)
        units.append((folder, False))
        open_folders.extend(_list_folder(folder)[0])
    units.extend((folder, True) for folder in open_folders)
    folders = spark.createDataFrame(units, "folder string, deep boolean")
    walked = folders.repartition(max(1, len(units))).mapInArrow(_walk, "file string, length bigint, modified bigint")
    name = F.element_at(F.split("file", "/"), -1)
    audit = F.when(F.col("length") == 0, "empty").when(F.col("length") > LARGE_FILE, "large")
    return (
        walked.withColumn("name", name)
        .filter(F.endswith(F.lower("name"), F.lit(extension.lower())))
        .filter(~F.startswith("name", F.lit(LOCK_PREFIX)))
        .select("file", "name", "length", "modified", audit.alias("audit"))
    )
