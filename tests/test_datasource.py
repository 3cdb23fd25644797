"""Workbooks read as a data source, against the decoder."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from tabrecover.sources import datasource as S
from tabrecover.sources.files import list_files
from tabrecover.sources.workbook import decode_workbooks
from workload.xlsx import Cell, cut_part, workbook


def folder(tmp_path):
    for n in range(12):
        sheets = [(f"s{i}", {r: {1: Cell("n", 100 * n + 10 * i + r)} for r in range(1, 4)}) for i in range(3)]
        place = tmp_path / ("deep/er" if n % 3 == 0 else ".")
        place.mkdir(parents=True, exist_ok=True)
        (place / f"b{n}.xlsx").write_bytes(workbook(sheets))
    (tmp_path / "broken.xlsx").write_bytes(b"broken")
    (tmp_path / "~$b1.xlsx").write_bytes(b"lock")
    whole = workbook([("s0", {1: {1: Cell("n", 1)}}), ("s1", {1: {1: Cell("n", 2)}})])
    (tmp_path / "cut.xlsx").write_bytes(cut_part(whole, "xl/worksheets/sheet2.xml", 0.5))
    return str(tmp_path)


def rows(df):
    return sorted(map(str, df.select("file", "sheet_idx", "sheet", "row", "cells", F.col("error").isNotNull()).collect()))


def test_source_is_the_decoder(spark, tmp_path):
    path = folder(tmp_path)
    S.register(spark)
    want = decode_workbooks(list_files(spark, [path]), partitions=2).cache()
    found = spark.read.format("workbook").option("split", 3).load(path)
    assert rows(found) == rows(want) and want.count() > 100
    one = f"{path}/b1.xlsx"
    for condition in (
        F.col("sheet") == "s1",
        F.col("sheet").isin("s0", "s2") & (F.col("row") > 1),
        (F.col("file") == one) & (F.col("sheet") == "s2"),
        F.col("sheet").isNull(),
        F.col("sheet").isNotNull() & F.col("error").isNull(),
        F.col("sheet") == "none",
    ):
        assert rows(found.filter(condition)) == rows(want.filter(condition)), condition


def test_only_wanted_sheets_are_opened(tmp_path, monkeypatch):
    path = folder(tmp_path)
    opened = []
    real = zipfile.ZipFile.open

    def recorded(self, name, *args, **kwargs):
        opened.append(name if isinstance(name, str) else name.filename)
        return real(self, name, *args, **kwargs)

    monkeypatch.setattr(zipfile.ZipFile, "open", recorded)
    reader = S.WorkbookReader(path, split=2)
    assert list(reader.pushFilters([EqualTo(("sheet",), "s1"), EqualTo(("row",), 1), In(("file",), (f"{path}/b1.xlsx", f"{path}/b2.xlsx"))])) == [EqualTo(("row",), 1)]
    found = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in found) == 6
    assert {o for o in opened if "worksheets" in o} == {"xl/worksheets/sheet2.xml"}
    assert sum("worksheets" in o for o in opened) == 2
