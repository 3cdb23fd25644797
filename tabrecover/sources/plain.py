"""Rows of a sheet by one pattern, for the form that spreadsheet programs write.

Building an element per cell costs far more than the cell itself. A sheet whose rows hold nothing but plain cells
(no prefixes, comments, marked sections or rich texts between them) is read by a pattern that has to match it
without a gap; anything else raises ``NotPlain``, and the sheet is read as elements. A parser without handlers
goes along, so a part that is not well-formed raises what reading it as elements raises. Rows in the strictest
form come as arrays before that (``sources.strict``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat
from zipfile import ZipFile

from tabrecover.sources.strict import NotPlain, StrictRows, strict_rows

_READ = 1 << 18
#: Bytes before the first row of a plain sheet, at most.
_HEAD = 1 << 20
_FIRST = re.compile(rb"<row[\s/>]")
_ANY_ROW = re.compile(rb"[<:]row[\s/>]")
_DECLARED = re.compile(rb"^(?:\xef\xbb\xbf)?<\?xml[^>]*?encoding\s*=\s*[\"']([^\"']*)[\"']")
_ROW_NUMBER = re.compile(r'\sr="([^"]*)"')
_TOKEN = re.compile(
    r'\s*(?:<c(?: r="([A-Z]{1,3})[0-9]+")?(?: s="([0-9]{1,6})")?(?: t="([A-Za-z]+)")?'
    r"(?:/>|>(?:<f(?:\s[^<>]*)?(?:/>|>[^<]*</f>))?"
    r'(?:<v>([^<]*)</v>|<v/>|<is><t(?: xml:space="preserve")?>([^<]*)</t></is>)?</c>)'
    r'|<row((?:\s+[A-Za-z0-9_:]+="[^"<&]*")*)\s*(/?)>|(</row>))'
)
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_ENTITY = re.compile("&([^;]*);")

#: Column letters, style, kind, text of the value and inline text of a cell; null where it has none.
Found = tuple[str | None, str | None, str | None, str | None, str | None]


def _text(text: str | None) -> str | None:
    if text is None or "&" not in text:
        return text
    return _ENTITY.sub(lambda m: _ENTITIES[m[1]], text)


def plain_rows(text: str) -> Iterator[tuple[str | None, list[Found]]]:
    """Number attribute and cells of each row of a text that holds whole rows."""
    if "\r" in text or "&#" in text:
        raise NotPlain
    cells: list[Found] | None = None
    number: str | None = None
    done = 0
    scan = _TOKEN.scanner(text)
    while (token := scan.match()) is not None:
        done = token.end()
        letters, style, kind, value, inline, row, closed, end = token.groups()
        if row is not None:
            if cells is not None:
                raise NotPlain
            found = _ROW_NUMBER.search(row)
            number = found[1] if found else None
            if closed:
                yield number, []
            else:
                cells = []
        elif cells is None:
            raise NotPlain
        elif end:
            yield number, cells
            cells = None
        else:
            cells.append((letters, style, kind, _text(value) or None, _text(inline)))
    if cells is not None or text[done:].strip(" \t\n"):
        raise NotPlain


def row_texts(book: ZipFile, part: str) -> Iterator[str]:
    """The rows of a part as texts of whole rows; the part has been read to its end after the last one."""
    for found in checked_rows(book, part):
        yield found.data.decode() if isinstance(found, StrictRows) else found


def checked_rows(book: ZipFile, part: str) -> Iterator[StrictRows | str]:
    """As ``row_texts``, but rows in the strictest form come as arrays.

    Those are well-formed, so the parser leaves them out; should it find fault with the rest, it reads the whole
    part for the place of the fault.
    """
    parser = expat.ParserCreate(namespace_separator="}")
    left_out = False
    depth = 0

    def checked(data: bytes, last: bool = False) -> None:
        try:
            parser.Parse(data, last)
        except expat.ExpatError as problem:
            if left_out:
                _check_whole(book, part)
            raise _fault(problem) from problem

    def opened(*_: object) -> None:
        nonlocal depth
        depth += 1

    def closed(*_: object) -> None:
        nonlocal depth
        depth -= 1

    parser.StartElementHandler, parser.EndElementHandler = opened, closed
    begun = False
    rest = b""
    with book.open(part) as stream:
        while chunk := stream.read(_READ):
            rest += chunk
            if not begun:
                first = _FIRST.search(rest)
                head = rest[: first.start()] if first else rest
                declared = _DECLARED.match(head)
                if b"<!" in head or b"\0" in head or len(head) > _HEAD or declared and declared[1].lower() != b"utf-8":
                    raise NotPlain
                if first is None:
                    continue
                if _ANY_ROW.search(head):
                    raise NotPlain
                checked(head)
                parser.StartElementHandler = parser.EndElementHandler = None
                rest = rest[first.start() :]
                begun = True
            end = rest.rfind(b"</row>") + len(b"</row>")
            if end >= len(b"</row>"):
                whole, rest = rest[:end], rest[end:]
                try:
                    if not depth:
                        raise NotPlain
                    found = strict_rows(whole)
                except NotPlain:
                    checked(whole)
                    try:
                        yield whole.decode()
                    except UnicodeDecodeError as problem:
                        raise NotPlain from problem
                else:
                    left_out = True
                    yield found
        checked(rest, True)
    if _ANY_ROW.search(rest):
        raise NotPlain


def _fault(problem: expat.ExpatError) -> Exception:
    if problem.code == expat.errors.codes[expat.errors.XML_ERROR_UNDEFINED_ENTITY]:
        return NotPlain()
    return ElementTree.ParseError(str(problem))


def _check_whole(book: ZipFile, part: str) -> None:
    """Raise what is wrong with a part, by its place in the whole of it."""
    parser = expat.ParserCreate(namespace_separator="}")
    try:
        with book.open(part) as stream:
            while chunk := stream.read(_READ):
                parser.Parse(chunk, False)
        parser.Parse(b"", True)
    except expat.ExpatError as problem:
        raise _fault(problem) from problem
