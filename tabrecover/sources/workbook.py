"""Workbook files to grid rows.

Two steps, both inside tasks: the sheets of every workbook are listed from the
zip directory, then every sheet is read by itself. So the unit of work is one
sheet, a workbook with many sheets spreads out, and a failing sheet or file
becomes one row with its error while the rest goes on. A sheet comes whole or
not at all: it is converted to its end before its first row is given out, a large
one twice, so that a task need not hold it. A cell that cannot be converted becomes
an error cell with its stored text, and a row or column number beyond the format's
own counts as missing: the row or cell then follows the one before it.
"""

from __future__ import annotations

import datetime as dt
import itertools
import math
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import cache, lru_cache
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tabrecover.sources.files import filesystem
from tabrecover.sources.plain import Found, NotPlain, checked_rows, plain_rows, row_texts
from tabrecover.sources.strict import StrictRows

# Fixed values of the file format: built-in number format codes by id.
NUMBER_FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 5: "$#,##0_);($#,##0)",
    6: "$#,##0_);[Red]($#,##0)", 7: "$#,##0.00_);($#,##0.00)", 8: "$#,##0.00_);[Red]($#,##0.00)",
    9: "0%", 10: "0.00%", 11: "0.00E+00",
    12: "# ?/?", 13: "# ??/??", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy",
    18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0_);(#,##0)", 38: "#,##0_);[Red](#,##0)", 39: "#,##0.00_);(#,##0.00)",
    40: "#,##0.00_);[Red](#,##0.00)", 41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)',
    42: '_($* #,##0_);_($* (#,##0);_($* "-"_);_(@_)', 43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)',
    44: '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)', 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}

# Fixed values of the file format: rows and columns of a sheet.
MAX_ROW, MAX_COLUMN = 1 << 20, 1 << 14

#: Cells of a batch of rows, and of a sheet that is kept until its end is reached.
_BATCH_CELLS, _HELD_CELLS = 20_000, 200_000
#: Digits of a whole number that is taken over as it is; ``int`` reads some thousands.
_LONGEST_AS_IS = 1000
#: Value, type and number format of a cell.
Read = tuple[str, str, str]
_CELL = pa.struct([("value", pa.string()), ("dtype", pa.string()), ("number_format", pa.string())])
_SHEETS = pa.schema([
    ("file", pa.string()), ("sheet_idx", pa.int64()), ("sheet", pa.string()),
    ("part", pa.string()), ("date1904", pa.bool_()), ("size", pa.int64()), ("error", pa.string()),
])
_ROWS = pa.schema([
    ("file", pa.string()), ("sheet_idx", pa.int64()), ("sheet", pa.string()), ("row", pa.int64()),
    ("cells", pa.list_(_CELL)), ("error", pa.string()),
])


def decode_workbooks(files: DataFrame, formulas: bool = False, partitions: int | None = None) -> DataFrame:
    """Grid rows of all sheets, and rows with an error for what could not be read.

    Gives file, sheet_idx, sheet, row, cells, error. A sheet without cells
    gives one row with number 0 and no cells. Formula cells hold their stored
    value, or with ``formulas`` their text (for templates). ``partitions`` is
    the number of decoding tasks; sheets are dealt out to them by hash, and those of
    one workbook that meet in a task share its strings and styles.
    Store the result before using it twice (``sinks.land_grid``).
    """
    partitions = _tasks(files, partitions)
    sheets = listed_sheets(files, partitions)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read_sheets(batches, formulas)

    dealt = sheets.repartition(partitions, "file", "sheet_idx").sortWithinPartitions("file", "sheet_idx")
    return dealt.mapInArrow(read, from_arrow_schema(_ROWS))


def _tasks(files: DataFrame, partitions: int | None) -> int:
    if partitions is not None:
        return partitions
    spark = files.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def listed_sheets(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """The sheets of every workbook: file, sheet_idx, sheet, part, date1904, size; or the file with an error."""
    spread = files.select("file").repartition(_tasks(files, partitions), "file")
    return spread.mapInArrow(_list_sheets, from_arrow_schema(_SHEETS))


def grid_of(decoded: DataFrame) -> DataFrame:
    """Sheet rows of decoded (or landed) workbooks."""
    return decoded.filter("error is null").drop("error")


def rejects_of(decoded: DataFrame) -> DataFrame:
    """Files and sheets that could not be read: file, sheet (null for the file), stage, reason."""
    return decoded.filter("error is not null").select(
        "file", "sheet", F.lit("decode").alias("stage"), F.col("error").alias("reason")
    )


def _list_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column(0).to_pylist():
            try:
                with _opened(file) as book:
                    rows = _sheet_parts(book, file)
                if not rows:
                    rows = [{"file": file, "error": "no sheets"}]
            except Exception as problem:  # any broken input is one reject, not a failed job
                rows = [{"file": file, "error": f"{type(problem).__name__}: {problem}"}]
            yield pa.RecordBatch.from_pylist(rows, schema=_SHEETS)


def _read_sheets(batches: Iterator[pa.RecordBatch], formulas: bool) -> Iterator[pa.RecordBatch]:
    shared: tuple[str, list[str], list[str]] | None = None
    for batch in batches:
        for sheet in batch.to_pylist():
            key = {k: sheet[k] for k in ("file", "sheet_idx", "sheet")}
            if sheet["error"]:
                yield pa.RecordBatch.from_pylist([{**key, "error": sheet["error"]}], schema=_ROWS)
                continue
            try:
                with _opened(sheet["file"]) as book:
                    if shared is None or shared[0] != sheet["file"]:
                        shared = (sheet["file"], _shared_strings(book), _style_formats(book))
                    plain = not formulas
                    try:
                        held, whole = _converted_whole(book, sheet, key, shared[1], shared[2], formulas, plain)
                    except NotPlain:
                        plain = False
                        held, whole = _converted_whole(book, sheet, key, shared[1], shared[2], formulas, plain)
            except Exception as problem:
                error = f"{type(problem).__name__}: {problem}"
                yield pa.RecordBatch.from_pylist([{**key, "error": error}], schema=_ROWS)
                continue
            if whole:
                yield from held
                continue
            # The first time went well, so what fails now is the storage: the task fails and runs again.
            with _opened(sheet["file"]) as book:
                yield from _row_batches(book, sheet, key, shared[1], shared[2], formulas, plain)


def _converted_whole(
    book: zipfile.ZipFile, sheet: dict, key: dict, strings: list[str], formats: list[str], formulas: bool, plain: bool
) -> tuple[list[pa.RecordBatch], bool]:
    """Convert a sheet to its end; its batches, or only the knowledge that it can be, if they are too many to hold."""
    held: list[pa.RecordBatch] = []
    whole, cells = True, 0
    for batch in _row_batches(book, sheet, key, strings, formats, formulas, plain):
        cells += batch.num_rows + len(batch.column("cells").values)
        if whole and cells <= _HELD_CELLS:
            held.append(batch)
        else:
            held, whole = [], False
    return held, whole


def _row_batches(
    book: zipfile.ZipFile, sheet: dict, key: dict, strings: list[str], formats: list[str], formulas: bool, plain: bool
) -> Iterator[pa.RecordBatch]:
    if plain:
        yield from _plain_batches(book, sheet, key, strings, formats)
        return
    yield from _batches(key, _sheet_rows(book, sheet["part"], sheet["date1904"], strings, formats, formulas, plain))


def _batches(key: dict, rows: Iterable[tuple[int, list[Read | None]]], empty: bool = True) -> Iterator[pa.RecordBatch]:
    """Batches of so many cells; ``empty`` gives the row of a sheet without cells, if there are none."""
    pending: list[tuple[int, list[Read | None]]] = []
    cells = 0
    for row, values in rows:
        pending.append((row, values))
        cells += len(values) + 1
        empty = False
        if cells >= _BATCH_CELLS:
            yield row_batch(key, pending)
            pending, cells = [], 0
    if empty:
        pending.append((0, []))
    if pending:
        yield row_batch(key, pending)


def _plain_batches(book: zipfile.ZipFile, sheet: dict, key: dict, strings: list[str], formats: list[str]) -> Iterator[pa.RecordBatch]:
    row = 0
    empty = True
    for found in checked_rows(book, sheet["part"]):
        if isinstance(found, StrictRows):
            batch = strict_batch(key, found, sheet["date1904"], strings, formats)
            row = int(found.numbers[-1])
            if batch.num_rows:
                empty = False
                yield batch
            continue
        numbered = [*numbered_plain(plain_rows(found), row, sheet["date1904"], strings, formats)]
        row = numbered[-1][0] if numbered else row
        for batch in _batches(key, ((n, cells) for n, cells in numbered if cells is not None), empty=False):
            empty = False
            yield batch
    if empty:
        yield row_batch(key, [(0, [])])


def row_batch(key: dict, rows: list[tuple[int, list[Read | None]]]) -> pa.RecordBatch:
    """Numbers and cells of some rows of one sheet as a batch, put together by column."""
    flat = [c for _, cells in rows for c in cells]
    missing = [c is None for c in flat]
    if any(missing):
        flat = [c or (None, None, None) for c in flat]
    parts = [pa.array([c[i] for c in flat], pa.string()) for i in range(3)]
    ends = [0, *itertools.accumulate(len(cells) for _, cells in rows)]
    return _batch(key, [number for number, _ in rows], ends, parts, missing)


def strict_batch(
    key: dict, rows: StrictRows, date1904: bool, strings: Sequence[str] | Mapping[int, str], formats: list[str]
) -> pa.RecordBatch:
    """As ``row_batch`` of what ``numbered_plain`` gives for the rows, without an object for each cell."""
    if len(rows.numbers) and rows.numbers.max() > MAX_ROW or len(rows.columns) and rows.columns.max() > MAX_COLUMN:
        raise NotPlain
    codes = [*formats, "General"]
    styles = np.minimum(rows.styles, len(formats))
    numeric = np.array([not (is_elapsed_format(code) or is_date_format(code)) for code in codes])[styles]
    n = len(rows.columns)
    size = rows.ends - rows.begins
    valued, untyped = size > 0, rows.kind_ends == 0
    buf = np.frombuffer(rows.data, np.uint8)
    number = valued & untyped & numeric
    # Whole numbers without zeros before them are their own text, as far as they can be read at all.
    as_is = number & rows.digits & (size <= _LONGEST_AS_IS) & ((size == 1) | (buf[rows.begins] != ord("0")))
    # Where the places of the values begin and end in turn; every second text is one.
    places = np.zeros(2 * n + 1, np.int32)
    places[0:-1:2], places[1::2] = rows.begins, rows.ends
    if not valued.all():
        places[:-1] = np.maximum.accumulate(places[:-1])
    places[-1] = places[-2] if n else 0
    texts = pa.StringArray.from_buffers(2 * n, pa.py_buffer(places), pa.py_buffer(rows.data))
    texts = texts.take(pa.array(np.arange(0, 2 * n, 2)))
    source, types = np.arange(n), np.zeros(n, np.int64)
    made: list[str | None] = []
    kinds: list[str | None] = []

    def make(kind: str | None, text: str, code: str, counts: bool) -> None:
        value, dtype = _plain_value(kind, text, None, strings, code, date1904, counts) or (None, None)
        made.append(value)
        kinds.append(dtype)

    # Other numbers and shared strings: each text once, whatever its style.
    shared = valued & (rows.kind_ends - rows.kind_begins == 1) & (buf[rows.kind_begins] == ord("s"))
    for kind, group in ((None, number & ~as_is), ("s", shared)):
        at = np.flatnonzero(group)
        if len(at):
            found = texts.take(pa.array(at)).dictionary_encode()
            source[at] = n + len(made) + found.indices.to_numpy()
            for text in found.dictionary.to_pylist():
                make(kind, text, "General", True)
    known: dict[tuple[str | None, int, str], int] = {}
    for i in np.flatnonzero(valued & ~number & ~shared).tolist():
        text = rows.data[rows.begins[i] : rows.ends[i]].decode()
        kind = None if untyped[i] else rows.data[rows.kind_begins[i] : rows.kind_ends[i]].decode()
        if kind is not None and not kind.isalpha():
            raise NotPlain
        place = known.get((kind, int(styles[i]), text))
        if place is None:
            place = known[kind, int(styles[i]), text] = len(made)
            make(kind, text, codes[styles[i]], bool(numeric[i]))
        source[i] = n + place
    texts = pa.concat_arrays([texts, pa.array(made, pa.string())])
    names = sorted({k for k in kinds if k is not None} | {"n"})
    if made:
        own = source >= n
        dtype_of = np.array([names.index(k) if k is not None else -1 for k in kinds], np.int64)
        types[:] = names.index("n")
        types[own] = dtype_of[source[own] - n]
        valued = valued & (types >= 0)
    # Cells of a row up to its last value; places without one are null.
    row_of = np.repeat(np.arange(len(rows.numbers)), rows.widths)
    length = np.zeros(len(rows.numbers), np.int64)
    np.maximum.at(length, row_of[valued], rows.columns[valued])
    kept = rows.widths > 0
    ends = np.concatenate([[0], np.cumsum(length[kept])])
    total = int(ends[-1])
    if total == n and valued.all():
        slots, missing = np.arange(n), None
    else:
        slots = np.full(total, -1)
        first = np.zeros(len(rows.numbers), np.int64)
        first[kept] = ends[:-1]
        slots[first[row_of[valued]] + rows.columns[valued] - 1] = np.flatnonzero(valued)
        missing = slots < 0

    def laid(values: pa.Array, which: np.ndarray) -> pa.Array:
        at = which[slots] if n else which[:0]
        return values.take(pa.array(at, mask=missing) if n else pa.nulls(total, pa.int64()))

    parts = [laid(texts, source), laid(pa.array(names), types), laid(pa.array(codes), styles)]
    return _batch(key, rows.numbers[kept], ends, parts, missing)


def _batch(key: dict, numbers: Sequence[int], ends: Sequence[int], parts: list[pa.Array], missing: Sequence[bool] | None) -> pa.RecordBatch:
    mask = None if missing is None else pa.array(missing, pa.bool_())
    made = pa.StructArray.from_arrays(parts, fields=list(_CELL), mask=mask)
    n = len(numbers)
    return pa.RecordBatch.from_arrays(
        [
            *[pa.array([key[f.name]] * n, f.type) for f in list(_ROWS)[:3]],
            pa.array(numbers, pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made, type=_ROWS.field("cells").type),
            pa.nulls(n, pa.string()),
        ],
        schema=_ROWS,
    )


@contextmanager
def _opened(file: str) -> Iterator[zipfile.ZipFile]:
    fs, path = filesystem(file)
    with fs.open_input_file(path) as stream, zipfile.ZipFile(stream) as book:
        yield book


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    """An attribute by its local name, whatever its namespace."""
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _elements(book: zipfile.ZipFile, part: str, name: str) -> Iterator[ElementTree.Element]:
    """Finished elements of one name, each forgotten after use."""
    with book.open(part) as stream:
        path: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(stream, events=("start", "end")):
            if event == "start":
                path.append(element)
                continue
            path.pop()
            if _tag(element) == name:
                yield element
                if path:
                    path[-1].remove(element)


def _sheet_parts(book: zipfile.ZipFile, file: str) -> list[dict]:
    parts = {
        _attribute(r, "Id"): (r.get("Type", ""), posixpath.normpath(posixpath.join("/xl", r.get("Target", ""))))
        for r in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")
    }
    flag = next((_attribute(p, "date1904") for p in _elements(book, "xl/workbook.xml", "workbookPr")), None)
    rows = []
    for element in _elements(book, "xl/workbook.xml", "sheet"):
        row = {"file": file, "sheet_idx": len(rows), "sheet": element.get("name"), "date1904": flag in ("1", "true")}
        kind, part = parts.get(_attribute(element, "id"), ("", ""))
        part = part.lstrip("/")
        if not kind.endswith("/worksheet"):
            row["error"] = "not a worksheet"
        elif part not in book.NameToInfo:
            row["error"] = "sheet part is missing"
        else:
            row.update(part=part, size=book.getinfo(part).file_size)
        rows.append(row)
    return rows


def _rich_text(element: ElementTree.Element) -> str:
    """Text of a string item; phonetic runs do not belong to it."""
    texts = []
    for child in element:
        if _tag(child) == "t":
            texts.append(child.text or "")
        elif _tag(child) == "r":
            texts.extend(t.text or "" for t in child if _tag(t) == "t")
    return _unescaped("".join(texts))


def _unescaped(text: str) -> str:
    """Characters that the file format writes as ``_xHHHH_``, in UTF-16; a half of a pair by itself becomes U+FFFD."""
    if "_x" not in text:
        return text
    plain = re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), text)
    return plain.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    part = "xl/sharedStrings.xml"
    return [_rich_text(si) for si in _elements(book, part, "si")] if part in book.NameToInfo else []


def _style_formats(book: zipfile.ZipFile) -> list[str]:
    """Number format code of every cell style."""
    part = "xl/styles.xml"
    if part not in book.NameToInfo:
        return []
    codes = dict(NUMBER_FORMATS)
    for own in _elements(book, part, "numFmts"):
        codes.update((int(f.get("numFmtId", 0)), f.get("formatCode", "General")) for f in own)
    styles = next(_elements(book, part, "cellXfs"), None)
    ids = [int(xf.get("numFmtId", 0)) for xf in styles] if styles is not None else []
    return [codes.get(i, "General") for i in ids]


_QUOTED = re.compile(r'"[^"]*"|\\.|[_*].|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.IGNORECASE)


@cache
def is_date_format(code: str) -> bool:
    """True if a number format code shows a date or a time."""
    if code == "General":
        return False
    return re.search("[dmhys]", _QUOTED.sub("", code.split(";")[0]), re.IGNORECASE) is not None


@cache
def is_elapsed_format(code: str) -> bool:
    """True if a format shows a length of time, such as ``[h]:mm:ss``."""
    return re.search(r"\[(h+|m+|s+)\]", code.split(";")[0], re.IGNORECASE) is not None


def elapsed_text(days: float) -> str:
    """Hours, minutes and seconds of a length of time in days; hours are not limited to a day."""
    millis = round(abs(days) * 86_400_000)
    seconds, rest = divmod(millis, 1000)
    sign = "-" if days < 0 and millis else ""
    text = f"{sign}{seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"
    return f"{text}.{rest:03}" if rest else text


def date_text(serial: float, date1904: bool) -> str:
    """Text of a serial date; days below 1 are times, the 1900 epoch has a leap day too many."""
    millis = dt.timedelta(milliseconds=round(serial * 86_400_000))
    if 0 <= serial < 1:
        return str((dt.datetime.min + millis).time())
    if date1904:
        return str(dt.datetime(1904, 1, 1) + millis)
    shift = dt.timedelta(days=1 if 0 < serial < 60 else 0)
    return str(dt.datetime(1899, 12, 30) + millis + shift)


def number_text(text: str) -> str:
    """Shortest text of a stored number; raises for what is none."""
    if text.isascii() and text.isdigit():
        return str(int(text))
    if "_" in text:
        raise ValueError(text)
    if "." in text or "e" in text or "E" in text:
        number = float(text)
        if not math.isfinite(number):
            raise ValueError(text)
        return repr(number)
    return str(int(text))


@lru_cache(MAX_COLUMN)
def column_number(ref: str) -> int:
    """1-based column of a cell address such as AB12; 0 if it names none."""
    col = 0
    for letter in ref.upper():
        if not "A" <= letter <= "Z":
            break
        col = col * 26 + ord(letter) - 64
        if col > MAX_COLUMN:
            return 0
    return col


def _number(text: str | None, default: int, largest: int = MAX_ROW) -> int:
    """A whole number of up to so many, else the default."""
    if text is None or not text.strip().isdecimal() or len(text.strip()) > 18:
        return default
    number = int(text)
    return number if number <= largest else default


def _sheet_rows(
    book: zipfile.ZipFile, part: str, date1904: bool, strings: list[str], formats: list[str], formulas: bool, plain: bool
) -> Iterator[tuple[int, list[Read | None]]]:
    if plain:
        row = 0
        for text in row_texts(book, part):
            found = plain_rows(text)
            for row, cells in numbered_plain(found, row, date1904, strings, formats):
                if cells is not None:
                    yield row, cells
        return
    yield from numbered_rows(_elements(book, part, "row"), 0, date1904, strings, formats, formulas)


def numbered_rows(
    elements: Iterable[ElementTree.Element],
    row: int,
    date1904: bool,
    strings: Sequence[str] | Mapping[int, str],
    formats: list[str],
    formulas: bool,
) -> Iterator[tuple[int, list[Read | None]]]:
    """Number and cells of every row with cells, up to the last value; styled cells without one count for the row.

    ``row`` is the number of the row before the first one.
    """
    for element in elements:
        row = _number(element.get("r"), row + 1)
        found: dict[int, Read] = {}
        col = 0
        for c in element:
            if _tag(c) != "c":
                continue
            col = column_number(c.get("r", "").rstrip("0123456789")) or col + 1
            style = _number(c.get("s"), 0)
            code = formats[style] if style < len(formats) else "General"
            one = _cell(c, strings, code, date1904, formulas)
            if one is not None:
                found[col] = (*one, code)
        if col:
            yield row, [found.get(i) for i in range(1, max(found, default=0) + 1)]


def numbered_plain(
    rows: Iterable[tuple[str | None, list[Found]]],
    row: int,
    date1904: bool,
    strings: Sequence[str] | Mapping[int, str],
    formats: list[str],
) -> Iterator[tuple[int, list[Read | None] | None]]:
    """As ``numbered_rows`` for plain rows; a row without cells is given with none, for its number."""
    styles = len(formats)
    counts = [not (is_elapsed_format(code) or is_date_format(code)) for code in formats]
    for number, cells in rows:
        row = _number(number, row + 1)
        out: list[Read | None] = []
        col = 0
        for letters, style, kind, text, inline in cells:
            col = (column_number(letters) if letters else 0) or col + 1
            place = int(style) if style else 0
            code = formats[place] if place < styles else "General"
            one = _plain_value(kind, text, inline, strings, code, date1904, place >= styles or counts[place])
            if one is not None:
                if col > len(out):
                    out.extend([None] * (col - len(out)))
                out[col - 1] = (*one, code)
        yield row, out if col else None


def _plain_value(
    kind: str | None, text: str | None, inline: str | None, strings: Sequence[str] | Mapping[int, str], code: str, date1904: bool, counts: bool
) -> tuple[str, str] | None:
    """As ``_value`` for a plain cell, an error cell if it cannot be converted; ``counts`` if its format shows no time."""
    try:
        if kind is None and text is not None and counts:
            return number_text(text), "n"
        return _value(kind or "n", text, inline and _unescaped(inline), strings, code, date1904)
    except (ValueError, IndexError, OverflowError):
        return text or "", "e"


def _cell(
    c: ElementTree.Element, strings: Sequence[str] | Mapping[int, str], code: str, date1904: bool, formulas: bool
) -> tuple[str, str] | None:
    """Value text and type of a cell, None if it has no value; an error cell if it cannot be converted."""
    inner = {_tag(child): child for child in c}
    try:
        return _converted(c.get("t", "n"), inner, strings, code, date1904, formulas)
    except (ValueError, IndexError, OverflowError):
        return (inner["v"].text or "") if "v" in inner else "", "e"


def _converted(
    kind: str, inner: dict[str, ElementTree.Element], strings: Sequence[str] | Mapping[int, str], code: str, date1904: bool, formulas: bool
) -> tuple[str, str] | None:
    if formulas and "f" in inner:
        return "=" + (inner["f"].text or ""), "f"
    inline = _rich_text(inner["is"]) if kind == "inlineStr" and "is" in inner else None
    return _value(kind, inner["v"].text if "v" in inner else None, inline, strings, code, date1904)


def _value(
    kind: str, text: str | None, inline: str | None, strings: Sequence[str] | Mapping[int, str], code: str, date1904: bool
) -> tuple[str, str] | None:
    """Value text and type of a cell by the text of its value, or its inline text."""
    if kind == "inlineStr":
        return (inline, "s") if inline is not None else None
    if text is None:
        return None
    if kind == "s":
        if int(text) < 0:
            raise IndexError(text)
        return strings[int(text)], "s"
    if kind == "b":
        return ("TRUE" if text.strip() in ("1", "true") else "FALSE"), "b"
    if kind == "d":
        return str(dt.datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)), "d"
    if kind == "n":
        if is_elapsed_format(code):
            return elapsed_text(float(text)), "d"
        return (date_text(float(text), date1904), "d") if is_date_format(code) else (number_text(text), "n")
    return (text, "e") if kind == "e" else (_unescaped(text), "s")
