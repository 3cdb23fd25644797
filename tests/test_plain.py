"""Plain sheets read by a pattern, against the same sheets read as elements."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
import pytest

from tabrecover.sources import pieces as P
from tabrecover.sources import workbook as X
from tabrecover.sources.plain import NotPlain, checked_rows
from tabrecover.sources.strict import StrictRows, strict_rows
from workload.xlsx import Cell, cut_part, number_rows, texts_of, workbook

PART = "xl/worksheets/sheet1.xml"
FORMATS = ["General", "0.00", "yyyy-mm-dd", "h:mm", "@", "[h]:mm:ss"]
STRINGS = ["zero", "one", "two"]


def book_of(body: str) -> zipfile.ZipFile:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr(PART, body)
    return zipfile.ZipFile(out)


def sheet(rows: str, after: str = "") -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="m" xmlns:x="n"><cols/><sheetData>{rows}</sheetData>{after}</worksheet>'


def read(book: zipfile.ZipFile, plain: bool) -> list:
    return [*X._sheet_rows(book, PART, False, STRINGS, FORMATS, False, plain)]


PLAIN = [
    '<row r="1"><c r="A1" s="0"><v>1</v></c><c r="C1" s="2"><v>40000.5</v></c></row>\n <row><c><v>1_0</v></c></row>',
    '<row r="3" spans="1:3" x:d="0.25"><c r="B3" t="s"><v>2</v></c><c r="B3" t="s"><v>9</v></c><c t="s"><v>-1</v></c></row>',
    '<row r="2"/><row><c r="A3" t="inlineStr"><is><t>a &lt;b&gt; &amp;amp;_x005F_x0041_</t></is></c><c r="D3" s="4"/></row>',
    '<row r="5"><c r="XFE5" t="b"><v>1</v></c><c s="99" t="str"><f>A1&amp;B1</f><v>x</v></c><c><f t="shared" si="0"/><v/></c></row>',
    '<row r="9"><c r="A9"><f t="shared" ref="A9:A10" si="0">1+1</f><v>0.10</v></c><c r="B9" s="5"><v>1.5</v></c><c t="e"><v>#N/A</v></c></row>',
    '<row r="7"></row><row r="1048577"><c t="d"><v>2024-01-02</v></c><c><v>1e400</v></c><c><v>&quot;</v></c><c><v>\u0663</v></c></row>',
]
OTHER = [
    '<row r="1"><!-- <row r="2"><c><v>5</v></c></row> --><c><v>1</v></c></row>',
    '<row r="1"><c r="A1"><v>1<![CDATA[2]]></v></c></row>',
    '<row r="1"><c t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>',
    "<row r='1'><c r='A1'><v>1</v></c></row>",
    '<row r="1"><c t="str" r="A1"><v>1&#65;</v></c></row>',
    '<x:row r="1"><x:c><x:v>1</x:v></x:c></x:row>',
    '<row r="1"><c><v>1</v></c><row r="2"><c><v>3</v></c></row></row>',
    '<row r="1"><c t="str"><v>a\r\nb</v></c></row>',
]


@pytest.mark.parametrize("rows", [*PLAIN, "".join(PLAIN), ""])
def test_plain_rows_are_those_read_as_elements(rows):
    book = book_of(sheet(rows, "<!-- <v>no</v> --><pageMargins/>" if rows else "<pageMargins/>"))
    assert read(book, True) == read(book, False)


@pytest.mark.parametrize("rows", OTHER)
def test_other_forms_are_left_to_the_elements(rows):
    with pytest.raises(NotPlain):
        read(book_of(sheet(rows)), True)
    with pytest.raises(NotPlain):
        read(book_of(sheet("", f"<x>{rows}</x>")), True)


@pytest.mark.parametrize("rows", [*PLAIN, *OTHER, "".join(PLAIN) * 40, ""])
@pytest.mark.parametrize("most", [1, 60, 1 << 20])
def test_cuts_are_those_of_elements(rows, most):
    book = book_of(sheet(rows, "<row/>"))
    assert P.cuts(book, PART, "sheetData", "row", most, None) == P._element_cuts(book, PART, "sheetData", "row", most, None)
    assert P.cuts(book, PART, "sheetData", "row", None, 2) == P._element_cuts(book, PART, "sheetData", "row", None, 2)


def test_long_and_broken_parts():
    rows = {n: {c: Cell("n" if n % 3 else "inline", f"{n * c}") for c in range(1, 8)} for n in range(1, 3000)}
    whole = workbook([("a", rows)])
    book = zipfile.ZipFile(io.BytesIO(whole))
    assert read(book, True) == read(book, False)
    assert P._plain_cuts(book, PART, "sheetData", "row", 4096, None) == P._element_cuts(book, PART, "sheetData", "row", 4096, None)
    for share in (0.001, 0.3, 0.95, 0.9999):
        cut = zipfile.ZipFile(io.BytesIO(cut_part(whole, PART, share)))
        told = []
        for plain in (True, False):
            with pytest.raises(ElementTree.ParseError) as problem:
                read(cut, plain)
            told.append(str(problem.value))
        assert told[0] == told[1]


def test_a_written_sheet_is_read_by_its_pattern(monkeypatch):
    """No element is built for a sheet in plain form."""
    monkeypatch.setattr(X, "_elements", None)
    book = zipfile.ZipFile(io.BytesIO(workbook([("a", {1: {1: Cell("s", "x"), 3: Cell("n", 2, 1, formula="1+1")}})])))
    assert [*X._sheet_rows(book, PART, False, ["x"], FORMATS, False, True)] == [(1, [("x", "s", "General"), None, ("2", "n", "0.00")])]


STRICT = [
    '<row r="1"><c r="A1" s="0"><v>1</v></c><c r="B1"><v>007</v></c><c r="C1" s="2"><v>40000.5</v></c><c r="D1" s="99"><v>1e3</v></c></row>',
    '<row r="2" spans="1:5"></row><row r="3"><c r="AB3" t="s"><v>1</v></c><c r="AC3" t="s"><v>9</v></c><c r="AE3" s="4"/></row>',
    '<row r="5"><c r="B5" s="1" t="b"><v>1</v></c><c r="D5" t="str"><v>"x" y</v></c><c r="E5" t="d"><v>2024-01-02</v></c><c r="F5"></c></row>',
    '<row r="9"><c r="A9" s="1"/><c r="B9"><v>1_0</v></c><c r="C9"><v>99999999999999999999</v></c><c r="D9"><v>12.50</v></c><c r="E9"><v></v></c></row>',
    '<row r="12"><c r="A12" s="3"/></row><row r="13"><c r="A13" t="inlineStr"><v>1</v></c><c r="B13" s="5"><v>1.5</v></c></row>',
]
NOT_STRICT = [
    '<row><c r="A1"><v>1</v></c></row>',
    '<row r="1"><c><v>1</v></c></row>',
    '<row r="1"><c r="B1"><v>1</v></c><c r="A1"><v>2</v></c></row>',
    '<row r="1"><c r="A1"><f>1+1</f><v>2</v></c></row>',
    '<row r="1"><c r="A1" t="str"><v>a&amp;b</v></c></row>',
    '<row r="1"><c r="A1" t="str"><v>a > b</v></c></row>',
    '<row r="1"><c t="s" s="1" r="A1"><v>1</v></c></row>',
    '<row r="1"><c r="A1" s="1" s="1"><v>1</v></c></row>',
    '<row r="1"><c r="A1"><v>1</v></c></row> <row r="2"/>',
    '<row r="1"><c r="AAAA1"><v>1</v></c></row>',
    '<row r="1"><c r="A1" t="str"><v>é</v></c></row>',
    '<row r="1"><c r="A1"><v>1</v></x></row>',
]


def batches(book: zipfile.ZipFile) -> list:
    found = X._row_batches(book, {"part": PART, "date1904": False}, {"file": "f", "sheet_idx": 0, "sheet": "s"}, STRINGS, FORMATS, False, True)
    return [(r["row"], [c and tuple(c.values()) for c in r["cells"]]) for batch in found for r in batch.to_pylist()]


@pytest.mark.parametrize("rows", [*STRICT, "".join(STRICT), "".join(STRICT) + PLAIN[0], *PLAIN])
def test_batches_of_strict_rows_are_those_read_as_elements(rows):
    book = book_of(sheet(rows))
    assert batches(book) == (read(book, False) or [(0, [])])


@pytest.mark.parametrize("rows", STRICT)
def test_strict_rows_are_found_as_arrays(rows):
    assert [type(found) for found in checked_rows(book_of(sheet(rows)), PART)] == [StrictRows]


@pytest.mark.parametrize("rows", NOT_STRICT)
def test_other_rows_are_not_strict(rows):
    with pytest.raises(NotPlain):
        strict_rows(rows.encode())


def test_faults_behind_strict_rows_have_their_place_in_the_part():
    rows = "".join(f'<row r="{n}"><c r="A{n}"><v>{n}</v></c></row>' for n in range(1, 20_000))
    whole = sheet(rows, "<pageMargins/>")
    for broken in (whole[: len(whole) * 9 // 10], whole.replace("<pageMargins/>", "</x>"), whole.replace("<v>15000</v>", "<v>15000</x>")):
        problems = []
        for plain in (True, False):
            with pytest.raises(ElementTree.ParseError) as problem:
                [*X._row_batches(book_of(broken), {"part": PART, "date1904": False}, {"file": "f", "sheet_idx": 0, "sheet": "s"}, [], FORMATS, False, plain)]
            problems.append(str(problem.value))
        assert problems[0] == problems[1]


def test_books_of_lines_are_written_as_cell_by_cell():
    column = pa.chunked_array([pa.array([1, None, 3])])
    double = pa.chunked_array([pa.array([1.0, 0.1, None])])
    head = {1: {1: Cell("s", "a")}}
    cells = {n: {1: Cell("n", str(a)), 2: Cell("n", str(b))} for n, (a, b) in enumerate(zip(column.to_pylist(), double.to_pylist()), 2)}
    fast = workbook([("lines", head)], below={"lines": number_rows(2, [texts_of(column), texts_of(double)])})
    slow = workbook([("lines", head | cells)])
    parts = [zipfile.ZipFile(io.BytesIO(data)) for data in (fast, slow)]
    assert [[book.read(n) for n in book.namelist()] for book in parts][0] == [parts[1].read(n) for n in parts[1].namelist()]
