"""Sheets decoded in pieces, against sheets decoded whole."""

from __future__ import annotations

import io
import random
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabrecover.plans.checkpoints import stored
from tabrecover.sources import pieces as P
from tabrecover.sources import workbook as X
from tabrecover.sources.files import list_files
from tests.test_workbooks import BROKEN, DATES, FORMULA, ODD_TEXTS, OFFSET, PLAIN
from workload.xlsx import Cell, cut_part, workbook

SHEET, STRINGS = "xl/worksheets/sheet1.xml", "xl/sharedStrings.xml"


def edited(data: bytes, **parts) -> bytes:
    """A workbook with parts changed: a function of the part's text, which gives text or bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as whole, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as copy:
        for name in whole.namelist():
            change = parts.get({SHEET: "sheet", STRINGS: "strings", "xl/styles.xml": "styles"}.get(name, ""))
            text = whole.read(name)
            copy.writestr(name, change(text.decode()) if change else text)
    return out.getvalue()


def long_rows(rng: random.Random, n: int) -> dict:
    rows = {}
    for row in sorted(rng.sample(range(1, 4 * n), n)):
        cells = {}
        for col in sorted(rng.sample(range(1, 12), rng.randint(0, 6))):
            kind = rng.choice(["s", "s", "n", "inline", "b", "empty", "str"])
            value = {"n": rng.randrange(1000), "b": 1, "empty": None}.get(kind, f"text <{rng.randrange(60)}> & é")
            cells[col] = Cell(kind, value, rng.randrange(4))
        rows[row] = cells
    return rows


def prefixed(text: str) -> str:
    text = text.replace('xmlns="', 'xmlns:m="')
    for tag in ("worksheet", "sheetData", "row", "c", "v", "f", "is", "t"):
        text = text.replace(f"<{tag} ", f"<m:{tag} ").replace(f"<{tag}>", f"<m:{tag}>").replace(f"</{tag}>", f"</m:{tag}>")
    return text


@pytest.fixture(scope="module")
def books(tmp_path_factory):
    root = tmp_path_factory.mktemp("pieces")
    rng = random.Random(3)
    many = workbook([("long", long_rows(rng, 300)), ("two", long_rows(rng, 80)), ("none", {}), ("hollow", {3: {}, 9: {}})], chart_sheet=True)
    found = {
        "plain": workbook([("S 1", PLAIN), ("Leer", {}), ("offset", OFFSET), ("formula", FORMULA)], chart_sheet=True),
        "dates1904": workbook([("D", DATES)], date1904=True),
        "odd": workbook([("odd", {**BROKEN, 5: {c: Cell("inline", t) for c, t in enumerate(ODD_TEXTS, 1)}})]),
        "many": many,
        "none": workbook([]),
        "prefixed": edited(many, sheet=prefixed),
        "utf16": edited(many, sheet=lambda t: t.replace("UTF-8", "UTF-16").encode("utf-16")),
        "latin": edited(many, sheet=lambda t: t.replace("UTF-8", "ISO-8859-1").encode("latin-1")),
        "unnumbered": edited(many, sheet=lambda t: t.replace("<row r=", "<row spans=")),
        "comments": edited(many, sheet=lambda t: t.replace("</row>", "<!-- <row r='1'> --></row><!-- </sheetData> -->", 40)),
        "controls": edited(many, sheet=lambda t: t.replace("</sheetData>", "</sheetData><controls><from><row>3</row></from></controls>")),
        "range": edited(many, sheet=lambda t: t.replace("<v>0</v>", "<v>-1</v>").replace("<v>1</v>", "<v>99999</v>").replace("<v>2</v>", "<v>2x</v>")),
        "cut_sheet": cut_part(many, SHEET, 0.95),
        "cut_strings": cut_part(many, STRINGS, 0.9),
        "cut_styles": cut_part(many, "xl/styles.xml", 0.5),
        "unbound": edited(many, sheet=lambda t: t[::-1].replace("<c "[::-1], "<q:c "[::-1], 1)[::-1]),
        "no_strings": edited(many, strings=lambda t: t.replace("sst", "other")),
        "zip": b"not a zip file",
    }
    for name, data in found.items():
        (root / f"{name}.xlsx").write_bytes(data)
    return root


def rows_of(decoded):
    return sorted(str(r.asDict(True)) for r in decoded.collect())


@pytest.mark.parametrize(("piece", "strings", "formulas"), [(1, 1, False), (3000, 7, True), (P.PIECE, P.STRINGS, False)])
def test_pieces_are_the_whole(spark, books, piece, strings, formulas):
    files = list_files(spark, [str(books)])
    whole = X.decode_workbooks(files, formulas, partitions=4)
    pieces = P.decode_in_pieces(files, formulas, 4, piece, strings)
    assert pieces.schema == whole.schema
    # Strings outside the table's own element count only where a sheet is decoded whole.
    expected, got = rows_of(whole.filter("file not like '%no_strings%'")), rows_of(pieces.filter("file not like '%no_strings%'"))
    assert len(expected) > 2500
    assert got == expected


def test_rejects_leave_no_rows(spark, books):
    decoded = P.decode_in_pieces(list_files(spark, [str(books)]), partitions=4, piece_bytes=500, strings=5).cache()
    lost = {(r.file.rsplit("/", 1)[1], r.sheet) for r in X.rejects_of(decoded).collect()}
    assert {("cut_sheet.xlsx", "long"), ("unbound.xlsx", "long"), ("zip.xlsx", None), ("none.xlsx", None)} <= lost
    assert {s for f, s in lost if f == "cut_strings.xlsx"} == {"long", "two", "none", "hollow", "Chart"}
    kept = {(r.file.rsplit("/", 1)[1], r.sheet) for r in X.grid_of(decoded).select("file", "sheet").distinct().collect()}
    assert not lost & kept
    assert X.rejects_of(decoded).count() == len(lost)


def test_no_piece_is_longer_than_asked(tmp_path):
    """Pieces end with the row that reaches the size; together they are the rows of the sheet in order."""
    rows = {n: {c: Cell("n", n) for c in range(1, 6)} for n in range(1, 2001)}
    (tmp_path / "long.xlsx").write_bytes(workbook([("long", rows)]))
    with X._opened(str(tmp_path / "long.xlsx")) as book:
        found = P.cuts(book, SHEET, "sheetData", "row", 4096, None)
        bodies = list(P._bodies(book, SHEET, found))
        text = book.read(SHEET).decode()
    assert "".join(bodies) == text[text.index("<row") : text.index("</sheetData>")]
    assert len(bodies) > 50 and max(map(len, bodies)) < 4096 + 200
    assert found.before == [int(b.split('r="', 1)[1].split('"', 1)[0]) - 1 for b in bodies]


def test_document_types_are_rejects(spark, tmp_path):
    declared = edited(workbook([("S", PLAIN)]), sheet=lambda t: t.replace("<worksheet", "<!DOCTYPE worksheet><worksheet"))
    (tmp_path / "typed.xlsx").write_bytes(declared)
    decoded = P.decode_in_pieces(list_files(spark, [str(tmp_path)]), partitions=2)
    assert [(r.sheet, r.reason) for r in X.rejects_of(decoded).collect()] == [("S", f"ValueError: document type in {SHEET}")]
    assert X.grid_of(decoded).count() == 0


def test_no_files(spark, tmp_path):
    assert P.decode_in_pieces(list_files(spark, [str(tmp_path)]), partitions=2).count() == 0


def test_a_task_gets_its_own_strings_only(spark, tmp_path):
    """What goes to a piece is what its cells show, whatever the length of the table."""
    rows = {n: {1: Cell("s", "head"), 2: Cell("s", f"text {n}")} for n in range(1, 3001)}
    (tmp_path / "strings.xlsx").write_bytes(workbook([("S", rows)]))
    files = list_files(spark, [str(tmp_path)])
    decoded = X.grid_of(P.decode_in_pieces(files, partitions=2, piece_bytes=2000, strings=16))
    texts = decoded.select("row", F.transform("cells", lambda c: c["value"]).alias("v")).collect()
    assert {r.row: r.v for r in texts} == {n: ["head", f"text {n}"] for n in rows}


def test_pieces_are_held_packed_and_a_few_at_a_time(spark, tmp_path):
    rows = {n: {c: Cell("n", n * c) for c in range(1, 11)} for n in range(1, 3000)}
    path = tmp_path / "book.xlsx"
    path.write_bytes(workbook([("lines", rows)]))
    sheet = {"file": str(path), "sheet_idx": 0, "sheet": "lines", "part": SHEET, "date1904": False, "error": None}
    batches = [*P._cut_sheets(1 << 16)(iter([pa.RecordBatch.from_pylist([sheet])]))]
    pieces = [piece for batch in batches for piece in P._each(batch)]
    with zipfile.ZipFile(path) as book:
        assert [P._body(p) for p in pieces] == [*P._bodies(book, SHEET, P.cuts(book, SHEET, "sheetData", "row", 1 << 16, None))]
    assert all(len(p["body"]) * 3 < len(P._body(p)) for p in pieces)

    noise = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(200)), lambda i: F.sha2(F.concat_ws("-", "id", i), 256)), "")
    wide = stored(spark.range(0, 1000, 1, 1).select("id", noise.alias("body")), 1 << 20)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in wide.inputFiles()]
    assert max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) <= 200
    assert wide.agg(F.count("body")).first()[0] == 1000
