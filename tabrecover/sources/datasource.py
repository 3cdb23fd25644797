"""Workbooks as a data source: ``spark.read.format("workbook").load(folder)``.

Gives the rows of ``decode_workbooks``, one per sheet row or reject. Planning opens no workbook: it lists
folders until there are enough to hand out, and each folder is dealt to ``split`` tasks by a
checksum of the file names, so one flat folder spreads out too. Conditions on file and sheet
(``=``, ``in``, is not null) are taken over by the source: a file that is not wanted is not opened, and of a wanted
workbook only its directory and the wanted sheets are read.

Options: ``split`` (tasks per folder, 8), ``formulas`` (true keeps formula texts). Register once with
``register(spark)``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from tabrecover.grid import GRID_SCHEMA
from tabrecover.sources import workbook as X
from tabrecover.sources.files import LOCK_PREFIX, _list_folder

SPLIT, FOLDERS = 8, 64


class FolderPart(InputPartition):
    """The files of a folder (with ``deep`` of all below it) whose checksum leaves ``rest``."""

    def __init__(self, folder: str, deep: bool, rest: int) -> None:
        super().__init__((folder, deep, rest))
        self.folder, self.deep, self.rest = folder, deep, rest


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return f"{GRID_SCHEMA}, error string"

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], int(self.options.get("split", SPLIT)), self.options.get("formulas", "") == "true")


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, split: int = SPLIT, formulas: bool = False) -> None:
        self.path, self.split, self.formulas = path.rstrip("/") or "/", split, formulas
        #: Values wanted of a column; a row must be in all of its sets.
        self.wanted: dict[str, list[set]] = {"file": [], "sheet": []}
        self.named = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In | IsNotNull) and len(f.attribute) == 1 else ""
            if column not in self.wanted:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted[column].append({f.value})
            elif isinstance(f, In):
                self.wanted[column].append(set(f.value))
            else:
                # Files always have a name; a reject of a whole file has no sheet.
                self.named |= column == "sheet"

    def partitions(self) -> list[FolderPart]:
        units, todo = [], [self.path]
        while todo and len(units) + len(todo) < FOLDERS:
            folder = todo.pop(0)
            units.append((folder, False))
            todo.extend(_list_folder(folder)[0])
        units.extend((folder, True) for folder in todo)
        return [FolderPart(folder, deep, rest) for folder, deep in units for rest in range(self.split)]

    def _is_wanted(self, column: str, value: str | None) -> bool:
        return all(value in some for some in self.wanted[column])

    def _files(self, part: FolderPart) -> Iterator[str]:
        todo = [part.folder]
        while todo:
            folders, files = _list_folder(todo.pop())
            todo.extend(folders if part.deep else [])
            for file, *_ in files:
                name = file.rpartition("/")[2]
                if name.lower().endswith(".xlsx") and not name.startswith(LOCK_PREFIX) and zlib.crc32(file.encode()) % self.split == part.rest:
                    if self._is_wanted("file", file):
                        yield file

    def read(self, partition: FolderPart) -> Iterator[pa.RecordBatch]:
        for file in self._files(partition):
            for sheets in X._list_sheets(iter([pa.RecordBatch.from_pydict({"file": [file]})])):
                keep = [self._is_wanted("sheet", s) and not (self.named and s is None) for s in sheets.column("sheet").to_pylist()]
                yield from X._read_sheets(iter([sheets.filter(pa.array(keep, pa.bool_()))]), self.formulas)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with conditions handed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WorkbookSource)
