"""Workbooks written to a fresh folder, listed, decoded, scanned, mapped and formatted."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tabrecover import jobs
from tabrecover.grid import grid_to_cells
from tabrecover.operators import bounds as B
from tabrecover.operators import decisions as D
from tabrecover.sources import lists as L
from tabrecover.sources.files import list_files
from tabrecover.sources.workbook import (
    column_number,
    date_text,
    decode_workbooks,
    grid_of,
    elapsed_text,
    is_date_format,
    number_text,
    rejects_of,
)
from workload.xlsx import Cell, cut_part, workbook


def s(text: str) -> Cell:
    return Cell("s", text)


PLAIN = {
    1: {1: s("Part"), 2: Cell("inline", "<b>Supplier</b>"), 3: s("Qty")},
    2: {1: Cell("n", "1.50"), 2: s("x & <y>"), 3: Cell("b", 1)},
    4: {1: Cell("n", "1E3"), 2: Cell("e", "#N/A"), 3: Cell("n", 7, 1)},
}
OFFSET = {
    1: {1: s("Export")},
    2: {1: s("  ")},
    3: {1: s("Item"), 2: s("Vendor")},
    4: {1: Cell("n", 1), 2: s("a")},
    5: {1: Cell("n", 2), 2: s("b")},
    8: {1: s("total"), 2: Cell("empty")},
    9: {3: Cell("empty", style=1)},
}
DATES = {1: {1: s("Date"), 2: s("Time")}, 2: {1: Cell("n", "40000", 2), 2: Cell("n", "0.5", 3)}, 3: {1: Cell("n", "59.25", 2), 2: Cell("d", "2024-02-03T04:05:06", 2)}}
FORMULA = {
    1: {1: s("Part"), 2: s("Supplier")},
    2: {1: Cell("n", 3, formula="1+2"), 2: Cell("str", "ab", formula='"a"&"b"')},
    3: {1: Cell("n", None, formula="A2"), 2: s("=B2")},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    (root / "deep" / "er").mkdir(parents=True)
    (root / "plain.xlsx").write_bytes(workbook([("S 1", PLAIN), ("Leer", {})], chart_sheet=True))
    (root / "deep" / "offset.xlsx").write_bytes(workbook([("A", OFFSET)]))
    (root / "deep" / "er" / "dates.XLSX").write_bytes(workbook([("D", DATES)]))
    (root / "dates1904.xlsx").write_bytes(workbook([("D", DATES)], date1904=True))
    (root / "_hidden.xlsx").write_bytes(workbook([("F", FORMULA)]))
    (root / ".dot.xlsx").write_bytes(workbook([]))
    (root / "~$lock.xlsx").write_bytes(b"lock")
    (root / "empty.xlsx").write_bytes(b"")
    (root / "bad.xlsx").write_bytes(b"not a zip file")
    (root / "notes.txt").write_text("no workbook")
    return root


@pytest.fixture(scope="module")
def decoded(spark, folder):
    return decode_workbooks(list_files(spark, [str(folder)]), partitions=4).cache()


def cells_of(decoded, name):
    cells = grid_to_cells(grid_of(decoded).filter(F.endswith("file", F.lit(name))), ("sheet",))
    return {(r.sheet, r.row, r.col): (r.value, r.dtype, r.number_format) for r in cells.collect()}


@pytest.mark.parametrize("fan_out", [1, 2, 100])
def test_listing(spark, folder, fan_out):
    found = {r.name: (r.file, r.length, r.audit) for r in list_files(spark, [f"{folder}/"], fan_out=fan_out).collect()}
    assert set(found) == {
        "plain.xlsx", "offset.xlsx", "dates.XLSX", "dates1904.xlsx", "_hidden.xlsx", ".dot.xlsx", "empty.xlsx", "bad.xlsx"
    }
    assert found["empty.xlsx"] == (f"{folder}/empty.xlsx", 0, "empty")
    assert found["dates.XLSX"][0] == f"{folder}/deep/er/dates.XLSX"
    assert found["bad.xlsx"][1:] == (14, None)


def test_listing_by_uri(spark, folder):
    found = [r.file for r in list_files(spark, [f"file://{folder}/deep"]).collect()]
    assert sorted(found) == [f"file://{folder}/deep/er/dates.XLSX", f"file://{folder}/deep/offset.xlsx"]
    assert decode_workbooks(list_files(spark, [f"file://{folder}/deep"]), partitions=2).count() == 10


def test_cells(decoded):
    plain = cells_of(decoded, "plain.xlsx")
    assert plain == {
        ("S 1", 1, 1): ("Part", "s", "General"),
        ("S 1", 1, 2): ("<b>Supplier</b>", "s", "General"),
        ("S 1", 1, 3): ("Qty", "s", "General"),
        ("S 1", 2, 1): ("1.5", "n", "General"),
        ("S 1", 2, 2): ("x & <y>", "s", "General"),
        ("S 1", 2, 3): ("TRUE", "b", "General"),
        ("S 1", 4, 1): ("1000.0", "n", "General"),
        ("S 1", 4, 2): ("#N/A", "e", "General"),
        ("S 1", 4, 3): ("7", "n", "0.00"),
    }
    assert cells_of(decoded, "dates.XLSX") == {
        ("D", 1, 1): ("Date", "s", "General"),
        ("D", 1, 2): ("Time", "s", "General"),
        ("D", 2, 1): ("2009-07-06 00:00:00", "d", "yyyy-mm-dd"),
        ("D", 2, 2): ("12:00:00", "d", "h:mm"),
        ("D", 3, 1): ("1900-02-28 06:00:00", "d", "yyyy-mm-dd"),
        ("D", 3, 2): ("2024-02-03 04:05:06", "d", "yyyy-mm-dd"),
    }
    assert cells_of(decoded, "dates1904.xlsx")["D", 2, 1][0] == "2013-07-07 00:00:00"
    assert cells_of(decoded, "_hidden.xlsx") == {
        ("F", 1, 1): ("Part", "s", "General"),
        ("F", 1, 2): ("Supplier", "s", "General"),
        ("F", 2, 1): ("3", "n", "General"),
        ("F", 2, 2): ("ab", "s", "General"),
        ("F", 3, 2): ("=B2", "s", "General"),
    }


def test_formula_texts_of_a_template(spark, folder):
    book = spark.createDataFrame([(f"{folder}/_hidden.xlsx",)], "file string")
    cells = grid_to_cells(grid_of(decode_workbooks(book, formulas=True, partitions=1)))
    assert {(r.row, r.col): (r.value, r.dtype) for r in cells.filter("row > 1").collect()} == {
        (2, 1): ("=1+2", "f"), (2, 2): ('="a"&"b"', "f"), (3, 1): ("=A2", "f"), (3, 2): ("=B2", "s"),
    }


def test_bounds_and_rejects(decoded):
    bounds = {(r.file.rsplit("/", 1)[1], r.sheet): r for r in B.sheet_bounds(grid_of(decoded)).collect()}
    empty = bounds["plain.xlsx", "Leer"]
    assert (empty.max_col, empty.header_row, empty.max_row, empty.sheet_idx) == (None, 1, 1, 1)
    offset = bounds["offset.xlsx", "A"]
    assert (offset.max_col, offset.header_row, offset.max_row) == (2, 3, 9)
    rejects = {(r.file.rsplit("/", 1)[1], r.sheet): r.reason for r in rejects_of(decoded).collect()}
    assert set(rejects) == {("empty.xlsx", None), ("bad.xlsx", None), (".dot.xlsx", None), ("plain.xlsx", "Chart")}
    assert rejects[".dot.xlsx", None] == "no sheets"
    assert rejects["plain.xlsx", "Chart"] == "not a worksheet"


def test_small_helpers():
    assert [column_number(r) for r in ("A1", "Z9", "AA1", "XFD7")] == [1, 26, 27, 16384]
    assert [number_text(t) for t in ("5", "5.0", "0.10000000000000001", "-1e-3")] == ["5", "5.0", "0.1", "-0.001"]
    dates = ["yyyy-mm-dd", "h:mm", "[h]:mm", "mmm-yy", "m/d/yy h:mm", "[$-409]d/m/yy"]
    others = ["General", "0.00", "@", '0" days"', "[Red]0.00", "#,##0_d", "0;dd", '"y"0']
    assert all(map(is_date_format, dates)) and not any(map(is_date_format, others))
    assert date_text(0, False) == "00:00:00" and date_text(61, False) == "1900-03-01 00:00:00"
    assert date_text(40000.5, False) == "2009-07-06 12:00:00"
    assert [elapsed_text(d) for d in (1.5, -0.25, 0.00001157407, 10)] == ["36:00:00", "-06:00:00", "00:00:01", "240:00:00"]


def test_scan_map_format(spark, folder, tmp_path):
    decoded = jobs.ingest(spark, [str(folder)], str(tmp_path / "grid"), partitions=4)
    jobs.scan(decoded, str(tmp_path / "scan"))
    scanned = L.read_lines(spark, str(tmp_path / "scan/scanned_columns"))
    headers = [r.header for r in scanned.orderBy("pos").collect()]
    assert headers == ["Date", "Item", "Part", "Qty", "Supplier", "Time", "Vendor"]
    total = spark.read.option("header", True).csv(str(tmp_path / "scan/total_stats")).first().asDict()
    assert {k: int(v) for k, v in total.items()} == {
        "files_processed": 8, "files_with_errors": 3, "sheets_processed": 6, "sheets_with_errors": 1,
        "headers_found": 11, "empty_headers": 0, "headers_cleaned": 1, "unique_headers": 7,
    }

    targets = spark.createDataFrame([(0, "part"), (1, "Supplier"), (2, "Date")], "pos int, target string")
    (tmp_path / "mapping.json").write_text(
        json.dumps({"mappings": [{"scanned_column": "Qty", "target_column": "", "is_ignored": True}, {"scanned_column": "Item", "target_column": "part"}]}, indent=2)
    )
    stored = L.read_mapping(spark, str(tmp_path / "mapping.json"))
    log = spark.createDataFrame(
        [("Vendor", 0, D.MAP, "Supplier"), ("Part", 1, D.TOGGLE_IGNORE, None), ("Part", 2, D.MAP, "part")],
        "scanned string, seq bigint, action string, target string",
    )
    session = jobs.map_headers(scanned, targets, stored, log, str(tmp_path / "map"))
    assert {r.scanned: (r.state, r.target) for r in session.collect()} == {
        "Qty": ("ignored", None), "Item": ("mapped", "part"), "Vendor": ("mapped", "Supplier"),
        "Part": ("mapped", "part"), "Supplier": ("mapped", "Supplier"), "Date": ("mapped", "Date"),
    }
    unmapped = spark.read.option("header", True).csv(str(tmp_path / "map/unmapped"))
    assert [r.header for r in unmapped.collect()] == ["Time"]
    coverage = spark.read.option("header", True).csv(str(tmp_path / "map/coverage")).first().asDict()
    assert {k: int(v) for k, v in coverage.items()} == {"total": 7, "mapped": 5, "suggested": 0, "ignored": 1, "unmapped": 1}
    fan_in = spark.read.option("header", True).csv(str(tmp_path / "map/fan_in"))
    assert {r.target: int(r.headers) for r in fan_in.collect()} == {"part": 2, "Supplier": 2, "Date": 1}
    replies = spark.createDataFrame([(0, "Time|Date|0.9\nVendor|part|0.2")], "reply bigint, text string")
    session = jobs.map_headers(scanned, targets, stored, log, str(tmp_path / "replied"), replies=replies)
    assert {(r.scanned, r.target) for r in session.filter("state = 'suggested'").collect()} == {("Time", "Date")}
    audit = spark.read.option("header", True).csv(str(tmp_path / "replied/audit"))
    assert [(r.header, r.outcome, r.target) for r in audit.collect()] == [("Time", "suggested", "Date")]
    own = jobs.map_headers(
        scanned, targets, stored, log, str(tmp_path / "scored"),
        scorer=lambda h, t: h.selectExpr("header as scanned", "'part' as target"),
    )
    assert {(r.scanned, r.target) for r in own.filter("state = 'suggested'").collect()} == {("Time", "part")}
    jobs.request_texts(str(tmp_path / "map"), targets, str(tmp_path / "requests"))
    assert "- Time" in spark.read.parquet(str(tmp_path / "requests")).first().request

    (tmp_path / "target.xlsx").write_bytes(
        workbook([("T", {1: {1: s("Standard")}, 2: {1: s("part"), 2: s(" Supplier "), 4: s("Date")}, 3: {1: Cell("n", 0, formula="1")}})])
    )
    _, layout = jobs.template(spark, str(tmp_path / "target.xlsx"), "T")
    assert layout.targets == ("part", "Supplier", "", "Date") and layout.header_row == 2
    old = spark.createDataFrame([(0, "Date"), (1, "Other")], "pos bigint, target string")
    jobs.extend_targets(old, str(tmp_path / "target.xlsx"), "T", str(tmp_path / "targets"))
    extended = L.read_targets(spark, str(tmp_path / "targets")).orderBy("pos").collect()
    assert [r.target for r in extended] == ["Date", "Other", "part", "Supplier"]
    mapping = L.read_mapping(spark, str(tmp_path / "map/mapping"))
    jobs.format_all(decoded, mapping, layout, str(tmp_path / "out"))
    rows = spark.read.option("inferSchema", False).parquet(str(tmp_path / "out/sheets"))
    got = {
        (r.file.rsplit("/", 1)[1], r.sheet, r.target_row): (r.part, r.Supplier, r.Date and str(r.Date)) for r in rows.collect()
    }
    assert got == {
        ("plain.xlsx", "S 1", 3): ("1.5", "x & <y>", None),
        ("plain.xlsx", "S 1", 4): ("1000.0", "#N/A", None),
        ("offset.xlsx", "A", 3): ("1", "a", None),
        ("offset.xlsx", "A", 4): ("2", "b", None),
        ("offset.xlsx", "A", 5): ("total", None, None),
        ("dates.XLSX", "D", 3): (None, None, "2009-07-06 00:00:00"),
        ("dates.XLSX", "D", 4): (None, None, "1900-02-28 06:00:00"),
        ("dates1904.xlsx", "D", 3): (None, None, "2013-07-07 00:00:00"),
        ("dates1904.xlsx", "D", 4): (None, None, "1904-02-29 06:00:00"),
        ("_hidden.xlsx", "F", 3): ("3", "ab", None),
    }
    columns = {r.target: (r.column_type, r.number_format) for r in spark.read.parquet(str(tmp_path / "out/columns")).collect()}
    assert columns["Date"] == ("timestamp_ntz", "yyyy-mm-dd") and columns["part"][0] == "string"
    status = spark.read.option("header", True).csv(str(tmp_path / "out/batch_summary"))
    assert {r.status: int(r.files) for r in status.collect()} == {"success": 4, "error": 4}
    rejects = spark.read.parquet(str(tmp_path / "out/rejects"))
    assert {(r.sheet, r.stage, r.reason) for r in rejects.collect()} >= {("Leer", "scan", "no header")}


BROKEN = {
    1: {1: s("a"), 2: s("b")},
    2: {1: Cell("n", "1x"), 2: Cell("s", "x")},
    3: {1: Cell("n", "1.5", 5), 2: Cell("inline", "a_x000D_b_x005F_x0041_"), 16384: Cell("empty", style=1)},
}


def test_sheets_come_whole_or_not_at_all(spark, tmp_path):
    """A cut sheet leaves no row, an unreadable cell is an error cell, and empty cells at the end are cut."""
    long = {n: {c: Cell("n", n) for c in range(1, 6)} for n in range(1, 9001)}
    whole = workbook([("long", long), ("odd", BROKEN)])
    (tmp_path / "cut.xlsx").write_bytes(cut_part(whole, "xl/worksheets/sheet1.xml", 0.99))
    decoded = decode_workbooks(list_files(spark, [str(tmp_path)]), partitions=2).cache()
    assert [r.sheet for r in rejects_of(decoded).collect()] == ["long"]
    assert {r.sheet for r in grid_of(decoded).select("sheet").distinct().collect()} == {"odd"}
    odd = {r.row: r.cells for r in grid_of(decoded).collect()}
    assert (odd[2][0].value, odd[2][0].dtype) == ("1x", "e")
    assert len(odd[3]) == 2 and odd[3][1].value == "a\rb_x0041_"
    assert odd[3][0].value == "36:00:00"


ODD_TEXTS = ["smile _xD83D_ x", "pair _xD83D__xDE00_", "_xDE00_", "_x0000_"]


def test_odd_cells_behind_many_rows(spark, tmp_path):
    """Halves of pairs, numbers beyond the format and strings out of range cut no sheet short, wherever they are."""
    rows = {n: {c: Cell("n", n) for c in range(1, 6)} for n in range(1, 12_001)}
    rows[11_990] = {c: Cell("inline", t) for c, t in enumerate(ODD_TEXTS, 1)}
    rows[11_991] = {1: Cell("n", "1e999"), 2: Cell("n", "nan"), 3: Cell("n", "1_0"), 4: Cell("n", "-1e-3")}
    data = workbook([("long", rows), ("strings", {1: {1: Cell("s", "first"), 2: Cell("s", "last")}})])
    swaps = {
        "xl/worksheets/sheet1.xml": [('<row r="11995">', '<row r="99999999999999999999999">'), ('r="A11996"', 'r="ZZZZZZZZZ1"')],
        "xl/worksheets/sheet2.xml": [("<v>0</v>", "<v>-1</v>"), ("<v>1</v>", "<v>7</v>")],
    }
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as whole, zipfile.ZipFile(out, "w") as copy:
        for part in whole.namelist():
            text = whole.read(part).decode()
            for old, new in swaps.get(part, []):
                assert old in text
                text = text.replace(old, new, 1)
            copy.writestr(part, text)
    (tmp_path / "odd.xlsx").write_bytes(out.getvalue())
    decoded = decode_workbooks(list_files(spark, [str(tmp_path)]), partitions=2).cache()
    assert rejects_of(decoded).count() == 0
    found = {(r.sheet, r.row): r.cells for r in grid_of(decoded).collect()}
    assert len(found) == 12_001
    assert [c.value for c in found["long", 11_990]] == ["smile \ufffd x", "pair \U0001f600", "\ufffd", "\0"]
    assert [(c.value, c.dtype) for c in found["long", 11_991]] == [("1e999", "e"), ("nan", "e"), ("1_0", "e"), ("-0.001", "n")]
    assert found["long", 11_995][0].value == "11995" and found["long", 11_996][0].value == "11996"
    assert [(c.value, c.dtype) for c in found["strings", 1]] == [("-1", "e"), ("7", "e")]


@pytest.mark.parametrize("share", [0.3, 0.99])
def test_large_sheets_cut_short(spark, tmp_path, share):
    """A sheet too large to hold is converted to its end before its first row is given out."""
    long = {n: {c: Cell("n", n) for c in range(1, 21)} for n in range(1, 12_001)}
    whole = workbook([("long", long)])
    (tmp_path / "cut.xlsx").write_bytes(cut_part(whole, "xl/worksheets/sheet1.xml", share))
    (tmp_path / "whole.xlsx").write_bytes(whole)
    decoded = decode_workbooks(list_files(spark, [str(tmp_path)]), partitions=2).cache()
    assert [r.file.rsplit("/", 1)[1] for r in rejects_of(decoded).collect()] == ["cut.xlsx"]
    assert {r.file.rsplit("/", 1)[1]: r.n for r in grid_of(decoded).groupBy("file").agg(F.count("*").alias("n")).collect()} == {"whole.xlsx": 12_000}


def test_missing_template_sheet(spark, tmp_path):
    (tmp_path / "t.xlsx").write_bytes(workbook([("Layout", {1: {1: Cell("s", "a")}})]))
    with pytest.raises(ValueError, match="no readable sheet 'Sheet1'"):
        jobs.template(spark, str(tmp_path / "t.xlsx"), "Sheet1")


def test_ingest_new_reads_only_new_files(spark, folder, tmp_path):
    first = jobs.ingest(spark, [str(folder / "deep")], str(tmp_path / "grid"), partitions=2)
    assert first.select("file").distinct().count() == 2
    before = first.count()
    again = jobs.ingest_new(spark, [str(folder / "deep")], str(tmp_path / "grid"), partitions=2)
    assert again.count() == before
    more = jobs.ingest_new(spark, [str(folder)], str(tmp_path / "grid"), partitions=2)
    assert more.select("file").distinct().count() == 8
    assert more.filter(F.col("file").contains("/deep/")).count() == before
