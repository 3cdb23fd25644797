"""Writes small workbooks, as input for queries and tests."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Mapping, Sequence
from functools import cache
from typing import NamedTuple
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
import pyarrow.compute as pc

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"

# Number formats by style number; style 0 is General.
STYLES = ("General", "0.00", "yyyy-mm-dd", "h:mm", "@", "[h]:mm:ss")


class Cell(NamedTuple):
    """A cell: kind is s (shared text), inline, n, b, e, str, d or empty."""

    kind: str
    value: object = None
    style: int = 0
    formula: str | None = None


Rows = Mapping[int, Mapping[int, Cell]]


@cache
def letters(col: int) -> str:
    out = ""
    while col:
        col, rest = divmod(col - 1, 26)
        out = chr(65 + rest) + out
    return out


#: Level of compression: files of nearly the size of the usual one, 6, in two thirds of its time.
LEVEL = 5


def texts_of(column: pa.ChunkedArray) -> pa.Array:
    """Texts of values as ``str`` gives them."""
    values = column.combine_chunks()
    if pa.types.is_integer(values.type):
        texts = values.cast(pa.string())
    else:
        found = values.dictionary_encode()
        texts = pa.array([str(v) for v in found.dictionary.to_pylist()], pa.string()).take(found.indices)
    return texts.fill_null("None")


def number_rows(first: int, columns: Sequence[pa.Array]) -> str:
    """Rows of number cells without a style, numbered from the first, by the texts of their columns."""
    numbers = pa.array(range(first, first + len(columns[0]))).cast(pa.string())
    parts: list[pa.Array | str] = ['<row r="', numbers, '">']
    for col, texts in enumerate(columns, 1):
        parts += [f'<c r="{letters(col)}', numbers, '" s="0"><v>', texts, "</v></c>"]
    return "".join(pc.binary_join_element_wise(*parts, "</row>", "").to_pylist())


def workbook(
    sheets: Sequence[tuple[str, Rows]], date1904: bool = False, chart_sheet: bool = False, below: Mapping[str, str] | None = None
) -> bytes:
    """Bytes of a workbook with the sheets in order; with a chart sheet at the end if wanted.

    ``below`` has finished rows by the sheet that they end (``number_rows``).
    """
    shared: dict[str, int] = {}
    parts: dict[str, str] = {}
    listed, related = [], []
    for i, (name, rows) in enumerate(sheets, 1):
        parts[f"xl/worksheets/sheet{i}.xml"] = _sheet(rows, shared, (below or {}).get(name, ""))
        listed.append(f"<sheet name={quoteattr(name)} sheetId=\"{i}\" r:id=\"rId{i}\"/>")
        related.append(f'<Relationship Id="rId{i}" Type="{RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>')
    if chart_sheet:
        n = len(sheets) + 1
        listed.append(f'<sheet name="Chart" sheetId="{n}" r:id="rId{n}"/>')
        related.append(f'<Relationship Id="rId{n}" Type="{RELS}/chartsheet" Target="chartsheets/sheet1.xml"/>')
    flag = '<workbookPr date1904="1"/>' if date1904 else "<workbookPr/>"
    parts["xl/workbook.xml"] = (
        f'<workbook xmlns="{MAIN}" xmlns:r="{RELS}">{flag}<sheets>{"".join(listed)}</sheets></workbook>'
    )
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{PACKAGE}">{"".join(related)}</Relationships>'
    strings = "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in shared)
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{MAIN}">{strings}</sst>'
    formats = "".join(f'<numFmt numFmtId="{200 + i}" formatCode={quoteattr(c)}/>' for i, c in enumerate(STYLES))
    styles = "".join(f'<xf numFmtId="{200 + i if i else 0}"/>' for i in range(len(STYLES)))
    parts["xl/styles.xml"] = (
        f'<styleSheet xmlns="{MAIN}"><numFmts>{formats}</numFmts><cellXfs>{styles}</cellXfs></styleSheet>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL) as book:
        for name, text in parts.items():
            book.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def cut_part(data: bytes, name: str, share: float) -> bytes:
    """A workbook with one part cut off after a share of its length."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as book, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=LEVEL) as copy:
        for part in book.namelist():
            content = book.read(part)
            copy.writestr(part, content[: int(len(content) * share)] if part == name else content)
    return out.getvalue()


def _sheet(rows: Rows, shared: dict[str, int], below: str = "") -> str:
    body = []
    for row, cells in sorted(rows.items()):
        inner = "".join(_cell(f"{letters(col)}{row}", c, shared) for col, c in sorted(cells.items()))
        body.append(f'<row r="{row}">{inner}</row>')
    return f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(body)}{below}</sheetData></worksheet>'


def _cell(ref: str, c: Cell, shared: dict[str, int]) -> str:
    if c.kind == "n" and c.formula is None and c.value is not None:
        return f'<c r="{ref}" s="{c.style}"><v>{escape(str(c.value))}</v></c>'
    start = f'<c r="{ref}" s="{c.style}"'
    if c.kind == "empty":
        return f"{start}/>"
    if c.kind == "inline":
        return f'{start} t="inlineStr"><is><t xml:space="preserve">{escape(str(c.value))}</t></is></c>'
    kind = "" if c.kind == "n" else f' t="{c.kind}"'
    text = c.value
    if c.kind == "s":
        text = shared.setdefault(str(c.value), len(shared))
    formula = f"<f>{escape(c.formula)}</f>" if c.formula is not None else ""
    value = f"<v>{escape(str(text))}</v>" if text is not None else ""
    return f"{start}{kind}>{formula}{value}</c>"
