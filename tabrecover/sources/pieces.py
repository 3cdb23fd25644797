"""Sheets of any length, each decoded by several tasks, without a string table in memory.

A part of a workbook is one compressed stream, so one task has to inflate it, but converting
cells costs far more than that. Four steps:

1. A part is read through once to see that it is well-formed and where its rows begin, then again to
   cut it there into pieces of some ``PIECE`` bytes; so a broken sheet gives no piece at all, only a reject.
   Each piece carries the number of the row before it and the name spaces it needs. The table of
   shared strings is cut the same way, after every ``STRINGS`` strings.
2. Each piece tells which strings its cells show.
3. These numbers are joined with the blocks of strings, so a piece gets the texts of its own cells. The first
   block holds the headers and is asked for by every piece of its workbook; the join is salted for it.
4. Pieces are converted by themselves, with the functions of ``sources.workbook``.

A task holds a piece, the texts of its cells and one block of strings, whatever the length of the sheet
and of the table. Pieces are compressed on their way and stored in small row groups, since readers and Arrow take thousands of rows at a time. The rows are those of ``decode_workbooks``. Two things differ, neither of
which the file format allows: a part with a document type is a reject, and rows outside the first ``sheetData``
do not count.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree
from xml.parsers import expat
from xml.sax.saxutils import quoteattr
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tabrecover.plans.checkpoints import stored
from tabrecover.plans.joins import lookup_join, salted_join
from tabrecover.sources import workbook as X
from tabrecover.sources.plain import NotPlain, plain_rows
from tabrecover.sources.strict import strict_rows

#: Bytes after which the next row starts a new piece, and shared strings of a block.
PIECE, STRINGS = 1 << 18, 1024
#: Bytes of a row group of stored pieces.
_GROUP = 8 << 20
_READ = 1 << 16
_STRING_PART = "xl/sharedStrings.xml"
_KEYS = ["file", "sheet_idx", "piece"]
_PIECES = pa.schema([
    ("file", pa.string()), ("sheet_idx", pa.int64()), ("sheet", pa.string()), ("date1904", pa.bool_()),
    ("piece", pa.int64()), ("before", pa.int64()), ("head", pa.string()), ("body", pa.binary()), ("error", pa.string()),
])
_NEEDED = pa.schema([
    ("file", pa.string()), ("sheet_idx", pa.int64()), ("piece", pa.int64()),
    ("block", pa.int64()), ("numbers", pa.list_(pa.int64())),
])
_TEXTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("texts", pa.list_(pa.string()))])


@dataclass
class Cuts:
    """Where the pieces of a part begin, the number of the item before each, and where the last one ends."""

    starts: list[int] = field(default_factory=list)
    before: list[int] = field(default_factory=list)
    stop: int = 0
    #: Name spaces declared up to the items, as attributes.
    head: str = ""
    encoding: str = "utf-8"
    #: True if an item has a cell.
    filled: bool = False


def cuts(book: ZipFile, part: str, container: str, item: str, piece_bytes: int | None, piece_items: int | None) -> Cuts:
    """Read a part to its end and find its cuts, after so many bytes or items; raises for what is not well-formed.

    Items are the children of the first container with the given name. Rows are numbered by
    their own number where they have one. Where items follow each other without anything between them, they
    are found by their tags, and the parser only checks them.
    """
    try:
        return _plain_cuts(book, part, container, item, piece_bytes, piece_items)
    except NotPlain:
        return _element_cuts(book, part, container, item, piece_bytes, piece_items)


def _plain_cuts(book: ZipFile, part: str, container: str, item: str, piece_bytes: int | None, piece_items: int | None) -> Cuts:
    """``cuts`` of a part whose container holds nothing but items, in UTF-8."""
    parser = expat.ParserCreate(namespace_separator=" ")
    found = Cuts()
    spaces: dict[str | None, str] = {}
    depth = inside = number = items = 0
    first: int | None = None
    name = item.encode()
    opened = re.compile(rb"\s*(<%b(?=[\s/>])([^<>]*?)(/?)>)" % name)
    inner = re.compile(rb"<%b[\s/>]|<[!?]" % name)
    closed, ended = b"</%b>" % name, re.compile(rb"\s*(</%b\s*>)" % container.encode())
    going_on = re.compile(rb"\s*(?:<%b[\s/>]|</%b[\s>])" % (name, container.encode()))

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal depth, inside, first
        depth += 1
        tag = name.rpartition(" ")[2]
        if not inside:
            inside = depth if tag == container else 0
        elif depth == inside + 1 and tag == item:
            first = parser.CurrentByteIndex
            parser.StartElementHandler = parser.EndElementHandler = parser.StartNamespaceDeclHandler = None

    def end(name: str) -> None:
        nonlocal depth
        if depth == inside:
            raise NotPlain
        depth -= 1

    def space(prefix: str | None, uri: str | None) -> None:
        spaces[prefix] = uri or ""

    def declared(version: str, encoding: str | None, standalone: int) -> None:
        found.encoding = encoding or found.encoding

    def doctype(*_: object) -> None:
        raise ValueError(f"document type in {part}")

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.StartNamespaceDeclHandler = space
    parser.XmlDeclHandler, parser.StartDoctypeDeclHandler = declared, doctype

    def take(rest: bytes, base: int) -> int:
        """Note the whole items that a text begins with; gives where they end."""
        nonlocal number, items
        at = 0
        while (tag := opened.match(rest, at)) is not None:
            stop = tag.end()
            if not tag[3]:
                stop = rest.find(closed, tag.end())
                if stop < 0:
                    break
                if inner.search(rest, tag.end(), stop):
                    raise NotPlain
                if not found.filled and re.compile(rb"<c[\s/>]").search(rest, tag.end(), stop):
                    if re.compile(rb"\s*<c[\s/>]").match(rest, tag.end()) is None:
                        raise NotPlain
                    found.filled = True
                stop += len(closed)
            if b"'" in tag[2] or b"&" in tag[2]:
                raise NotPlain
            place = base + tag.start(1)
            by_bytes = piece_bytes is not None and found.starts and place - found.starts[-1] >= piece_bytes
            by_items = piece_items is not None and items % piece_items == 0
            if not found.starts or by_bytes or by_items:
                found.starts.append(place)
                found.before.append(number)
            own = re.search(rb'\sr="([^"]*)"', tag[2])
            number = X._number(own[1].decode() if own else None, number + 1)
            items += 1
            at = stop
        return at

    with book.open(part) as stream:
        chunk = stream.read(_READ)
        if chunk[:2] in (b"\xff\xfe", b"\xfe\xff"):
            raise NotPlain
        offset, rest = 0, b""
        try:
            while chunk:
                parser.Parse(chunk, False)
                if not found.stop:
                    rest += chunk
                    if first is None:
                        # a tag may have begun in the text before
                        cut = max(0, len(rest) - 2 * _READ)
                        rest, offset = rest[cut:], offset + cut
                    else:
                        if not found.starts:
                            if first < offset or found.encoding.lower() != "utf-8":
                                raise NotPlain
                            rest, offset = rest[first - offset :], first
                        at = take(rest, offset)
                        rest, offset = rest[at:], offset + at
                        last = ended.match(rest)
                        if last is not None:
                            found.stop = offset + last.start(1)
                        elif len(rest) > 2 * _READ and going_on.match(rest) is None:
                            raise NotPlain
                chunk = stream.read(_READ)
            parser.Parse(b"", True)
        except expat.ExpatError as problem:
            raise ElementTree.ParseError(str(problem)) from problem
    if not found.stop:
        raise NotPlain
    found.head = _declarations(spaces)
    return found


def _declarations(spaces: dict[str | None, str]) -> str:
    return "".join(f" xmlns:{p}={quoteattr(u)}" if p else f" xmlns={quoteattr(u)}" for p, u in spaces.items() if p != "xml")


def _element_cuts(book: ZipFile, part: str, container: str, item: str, piece_bytes: int | None, piece_items: int | None) -> Cuts:
    """``cuts`` of any part."""
    parser = expat.ParserCreate(namespace_separator=" ")
    found = Cuts()
    spaces: dict[str | None, str] = {}
    depth = inside = number = items = 0
    done = False

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal depth, inside, number, items
        depth += 1
        if done:
            return
        tag = name.rpartition(" ")[2]
        if not inside:
            inside = depth if tag == container else 0
        elif depth == inside + 1 and tag == item:
            at = parser.CurrentByteIndex
            by_bytes = piece_bytes is not None and found.starts and at - found.starts[-1] >= piece_bytes
            by_items = piece_items is not None and items % piece_items == 0
            if not found.starts or by_bytes or by_items:
                found.starts.append(at)
                found.before.append(number)
            number = X._number(attributes.get("r"), number + 1)
            items += 1
        elif depth == inside + 2 and tag == "c":
            found.filled = True

    def end(name: str) -> None:
        nonlocal depth, done
        if depth == inside and not done:
            done = True
            found.stop = parser.CurrentByteIndex
        depth -= 1

    def space(prefix: str | None, uri: str | None) -> None:
        if not found.starts:
            spaces[prefix] = uri or ""

    def declared(version: str, encoding: str | None, standalone: int) -> None:
        found.encoding = encoding or found.encoding

    def doctype(*_: object) -> None:
        raise ValueError(f"document type in {part}")

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.StartNamespaceDeclHandler = space
    parser.XmlDeclHandler, parser.StartDoctypeDeclHandler = declared, doctype
    with book.open(part) as stream:
        chunk = stream.read(_READ)
        mark = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(chunk[:2])
        try:
            while chunk:
                parser.Parse(chunk, False)
                chunk = stream.read(_READ)
            parser.Parse(b"", True)
        except expat.ExpatError as problem:
            raise ElementTree.ParseError(str(problem)) from problem
    found.encoding = mark or found.encoding
    found.head = _declarations(spaces)
    return found


def _bodies(book: ZipFile, part: str, found: Cuts) -> Iterator[str]:
    with book.open(part) as stream:
        if found.starts:
            stream.seek(found.starts[0])
        for start, stop in zip(found.starts, [*found.starts, found.stop][1:], strict=True):
            yield stream.read(stop - start).decode(found.encoding)


def _packed(body: str) -> bytes:
    return zlib.compress(body.encode(), 1)


def _body(piece: dict) -> str:
    return zlib.decompress(piece["body"]).decode()


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time: together their bodies would be held twice."""
    for i in range(batch.num_rows):
        yield from batch.slice(i, 1).to_pylist()


def _items(piece: dict) -> Iterator[ElementTree.Element]:
    """The items of a piece."""
    yield from ElementTree.fromstring(f"<piece{piece['head']}>{_body(piece)}</piece>")


def _cut_sheets(piece_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sheet in batch.to_pylist():
                key = {k: sheet[k] for k in ("file", "sheet_idx", "sheet", "date1904")} | {"piece": 0, "before": 0}
                if sheet["error"]:
                    yield pa.RecordBatch.from_pylist([{**key, "error": sheet["error"]}], schema=_PIECES)
                    continue
                try:
                    with X._opened(sheet["file"]) as book:
                        X._style_formats(book)
                        found = cuts(book, sheet["part"], "sheetData", "row", piece_bytes, None)
                except Exception as problem:  # any broken input is one reject, not a failed job
                    error = f"{type(problem).__name__}: {problem}"
                    yield pa.RecordBatch.from_pylist([{**key, "error": error}], schema=_PIECES)
                    continue
                if not found.filled:
                    yield pa.RecordBatch.from_pylist([key], schema=_PIECES)
                    continue
                # The first time went well, so what fails now is the storage: the task fails and runs again.
                with X._opened(sheet["file"]) as book:
                    for i, body in enumerate(_bodies(book, sheet["part"], found)):
                        row = {**key, "piece": i, "before": found.before[i], "head": found.head, "body": _packed(body)}
                        yield pa.RecordBatch.from_pylist([row], schema=_PIECES)

    return run


def _cut_strings(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                try:
                    with X._opened(file) as book:
                        if _STRING_PART not in book.NameToInfo:
                            continue
                        found = cuts(book, _STRING_PART, "sst", "si", None, block)
                except Exception as problem:
                    row = {"file": file, "error": f"{type(problem).__name__}: {problem}"}
                    yield pa.RecordBatch.from_pylist([row], schema=_PIECES)
                    continue
                with X._opened(file) as book:
                    for i, body in enumerate(_bodies(book, _STRING_PART, found)):
                        row = {"file": file, "piece": i, "head": found.head, "body": _packed(body)}
                        yield pa.RecordBatch.from_pylist([row], schema=_PIECES)

    return run


def _string_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _each(batch):
            texts = [X._rich_text(si) for si in _items(piece) if X._tag(si) == "si"]
            row = {"file": piece["file"], "block": piece["piece"], "texts": texts}
            yield pa.RecordBatch.from_pylist([row], schema=_TEXTS)


def _shown(cell: ElementTree.Element) -> int | None:
    """The number of the shared string that a cell shows."""
    if X._tag(cell) != "c" or cell.get("t") != "s":
        return None
    return _string_number(next((v.text for v in cell if X._tag(v) == "v"), None))


def _string_number(text: str | None) -> int | None:
    try:
        number = int(text or "")
    except ValueError:
        return None
    return number if 0 <= number < 1 << 62 else None


#: Without an attribute of this name no cell shows a shared string.
_TYPED = re.compile(r"\bt\s*=")


def _needed(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _each(batch):
                by_block: dict[int, set[int]] = {}
                body = _body(piece)
                if _TYPED.search(body) is None:
                    continue
                try:
                    cells = (c for _, found in plain_rows(body) for c in found)
                    shown = {_string_number(text) for _, _, kind, text, _ in cells if kind == "s"}
                except NotPlain:
                    shown = {_shown(cell) for row in _items(piece) for cell in row}
                for number in shown - {None}:
                    by_block.setdefault(number // block, set()).add(number)
                key = {k: piece[k] for k in _KEYS}
                rows = [{**key, "block": b, "numbers": sorted(n)} for b, n in sorted(by_block.items())]
                yield pa.RecordBatch.from_pylist(rows, schema=_NEEDED)

    return run


class _Strings(dict):
    """The texts of a piece by number; one that the table does not hold is missing as from a list."""

    def __missing__(self, number: int) -> str:
        raise IndexError(number)


def _converted(formulas: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        styles: tuple[str, list[str]] | None = None
        for batch in batches:
            for piece in _each(batch):
                key = {k: piece[k] for k in ("file", "sheet_idx", "sheet")}
                if piece["body"] is None:
                    rest = {"error": piece["error"]} if piece["error"] else {"row": 0, "cells": []}
                    yield pa.RecordBatch.from_pylist([{**key, **rest}], schema=X._ROWS)
                    continue
                if styles is None or styles[0] != piece["file"]:
                    with X._opened(piece["file"]) as book:
                        styles = (piece["file"], X._style_formats(book))
                strings = _Strings((t["number"], t["text"]) for t in piece["texts"] or [] if t["text"] is not None)
                body = _body(piece)
                try:
                    if formulas:
                        raise NotPlain
                    batch = X.strict_batch(key, strict_rows(body.encode()), piece["date1904"], strings, styles[1])
                    if batch.num_rows:
                        yield batch
                    continue
                except NotPlain:
                    pass
                try:
                    if formulas:
                        raise NotPlain
                    plain = X.numbered_plain(plain_rows(body), piece["before"], piece["date1904"], strings, styles[1])
                    rows = [(n, cells) for n, cells in plain if cells is not None]
                except NotPlain:
                    elements = (e for e in _items(piece) if X._tag(e) == "row")
                    rows = [*X.numbered_rows(elements, piece["before"], piece["date1904"], strings, styles[1], formulas)]
                yield X.row_batch(key, rows)

    return run


def decode_in_pieces(
    files: DataFrame,
    formulas: bool = False,
    partitions: int | None = None,
    piece_bytes: int = PIECE,
    strings: int = STRINGS,
) -> DataFrame:
    """As ``decode_workbooks``: file, sheet_idx, sheet, row, cells, error.

    The inflated sheets are written once to the checkpoint folder, which pays where
    sheets or string tables are long; very many short sheets are better decoded whole.
    """
    sheets = stored(X.listed_sheets(files, partitions))
    n = sheets.sparkSession.sparkContext.defaultParallelism * 4 if partitions is None else partitions
    dealt = sheets.repartition(n, "file", "sheet_idx")
    pieces = stored(dealt.mapInArrow(_cut_sheets(piece_bytes), from_arrow_schema(_PIECES)), _GROUP)
    books = sheets.filter("part is not null").select("file").distinct().repartition(n, "file")
    tables = stored(books.mapInArrow(_cut_strings(strings), from_arrow_schema(_PIECES)), _GROUP)

    # A workbook whose strings cannot be read loses each of its sheets as a whole.
    broken = tables.filter("error is not null").select("file", F.col("error").alias("broken"))
    marked = lookup_join(pieces, broken, ["file"], "left").filter("broken is null or piece = 0")
    lost = F.col("broken").isNotNull() & F.col("body").isNotNull()
    error = F.when(F.col("error").isNull(), F.col("broken")).otherwise(F.col("error"))
    marked = marked.withColumn("error", error).withColumn("body", F.when(~lost, F.col("body"))).drop("broken")

    blocks = tables.filter("body is not null").repartition(n, "file", "piece").mapInArrow(_string_texts, from_arrow_schema(_TEXTS))
    spread = pieces.filter("body is not null").repartition(n, *_KEYS)
    needed = stored(spread.mapInArrow(_needed(strings), from_arrow_schema(_NEEDED)))
    found = salted_join(needed, blocks, ["file", "block"])
    text = F.transform(
        "numbers", lambda i: F.struct(i.alias("number"), F.get("texts", (i - F.col("block") * strings).cast("int")).alias("text"))
    )
    shown = found.select(*_KEYS, text.alias("found")).groupBy(*_KEYS).agg(F.flatten(F.collect_list("found")).alias("texts"))
    whole = marked.join(shown, _KEYS, "left").sortWithinPartitions(*_KEYS)
    return whole.mapInArrow(_converted(formulas), from_arrow_schema(X._ROWS))
