"""Rows in the strictest form of a plain sheet, all cells of a text at once.

Most sheets that programs write are ASCII rows of ``<c r="B2" s="1" t="s"><v>7</v></c>`` with nothing between the tags.
Their tags are found and checked as arrays, which costs a few nanoseconds a byte and not a pattern for each cell. A text with
anything else (formulas, inline texts, entities, line breaks, cells or rows without an address, columns that do not rise)
raises ``NotPlain`` and is read by the pattern. What passes is well-formed by itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

# Kinds of tags: row, cell, value and their ends, and a cell without content.
_ROW, _CELL, _VALUE, _VALUE_END, _CELL_END, _ROW_END, _EMPTY = range(7)
_KIND = np.full(1 << 16, 255, np.uint8)
for _start, _kind in ((b"ro", _ROW), (b"c ", _CELL), (b"v>", _VALUE), (b"/v", _VALUE_END), (b"/c", _CELL_END), (b"/r", _ROW_END)):
    _KIND[_start[0] << 8 | _start[1]] = _kind
_FOLLOWS = np.zeros((7, 7), bool)
for _kind, _next in (
    (_ROW, (_CELL, _EMPTY, _ROW_END)),
    (_CELL, (_VALUE, _CELL_END)),
    (_VALUE, (_VALUE_END,)),
    (_VALUE_END, (_CELL_END,)),
    (_CELL_END, (_CELL, _EMPTY, _ROW_END)),
    (_EMPTY, (_CELL, _EMPTY, _ROW_END)),
    (_ROW_END, (_ROW,)),
):
    _FOLLOWS[_kind, list(_next)] = True
_FOLLOWS = _FOLLOWS.ravel()
#: Bytes of the tags that are always the same, without their first one and with their last.
_LENGTH = np.array([0, 0, 2, 3, 3, 5, 0])
_SPANS = re.compile(rb' spans="[0-9]+:[0-9]+"')
_MOST_ROW_DIGITS, _MOST_STYLE_DIGITS = 7, 6


class NotPlain(Exception):
    """The part has to be read as elements, or the text by the pattern."""


@dataclass(frozen=True)
class StrictRows:
    """The rows of a text; places are bytes of it."""

    data: bytes
    #: Number of each row, where it begins, and how many cells it has.
    numbers: np.ndarray
    starts: np.ndarray
    widths: np.ndarray
    #: Column and style of each cell, and where its value begins and ends (both 0 without one).
    columns: np.ndarray
    styles: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    #: Where the type of each cell begins and ends (both 0 without one).
    kind_begins: np.ndarray
    kind_ends: np.ndarray
    #: True where the value is digits only.
    digits: np.ndarray


def _require(condition: bool | np.bool_) -> None:
    if not condition:
        raise NotPlain


def _whole(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, most: int) -> np.ndarray:
    """The numbers that some digits stand for."""
    size = ends - begins
    _require(len(size) == 0 or size.max() <= most)
    out = np.zeros(len(size), np.int64)
    if len(size) and size.max() == 1:
        return out + (buf[begins] - 48)
    for i in range(int(size.max()) if len(size) else 0):
        own = size > i
        out[own] = out[own] * 10 + (buf[begins[own] + i] - 48)
    return out


def strict_rows(data: bytes) -> StrictRows:
    """Rows of a text of whole rows; raises ``NotPlain`` for any other form than the strictest."""
    _require(data and data.isascii() and b"&" not in data)
    buf = np.frombuffer(data, np.uint8)
    _require(buf.min() >= 32)
    opened, closed = np.flatnonzero(buf == ord("<")), np.flatnonzero(buf == ord(">"))
    _require(len(opened) and len(opened) == len(closed) and opened[0] == 0 and closed[-1] == len(buf) - 1)
    size, gap = closed - opened, opened[1:] - closed[:-1] - 1
    _require(size.min() >= 2 and (not len(gap) or gap.min() >= 0))
    kind = _KIND[buf[opened + 1].astype(np.uint16) << 8 | buf[opened + 2]]
    _require(kind.max() < 255 and kind[0] == _ROW and kind[-1] == _ROW_END)
    kind[(kind == _CELL) & (buf[closed - 1] == ord("/"))] = _EMPTY
    _require(_FOLLOWS[kind[:-1] * 7 + kind[1:]].all())
    _require((gap[kind[:-1] != _VALUE] == 0).all())
    fixed = _LENGTH[kind]
    _require((size[fixed > 0] == fixed[fixed > 0]).all())
    row_ends = opened[kind == _ROW_END]
    _require((buf[row_ends + 3] == ord("o")).all() and (buf[row_ends + 4] == ord("w")).all())

    quotes = np.flatnonzero(buf == ord('"'))
    digit = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf - np.uint8(ord("0")) < 10, out=digit[1:])

    def only_digits(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (ends > begins) & (digit[ends] - digit[begins] == ends - begins)

    row_tags = np.flatnonzero(kind == _ROW)
    starts, ends = opened[row_tags], closed[row_tags]
    first = np.searchsorted(quotes, starts)
    _require(first[-1] + 1 < len(quotes))
    begins, stops = quotes[first] + 1, quotes[first + 1]
    _require((begins == starts + 8).all() and (stops < ends).all())
    for i, letter in enumerate(b'w r="', 3):
        _require((buf[starts + i] == letter).all())
    _require(only_digits(begins, stops).all())
    for i in np.flatnonzero(stops + 1 != ends):
        _require(_SPANS.fullmatch(data, int(stops[i]) + 1, int(ends[i])) is not None)
    numbers = _whole(buf, begins, stops, _MOST_ROW_DIGITS)

    cell_tags = np.flatnonzero((kind == _CELL) | (kind == _EMPTY))
    places, ends = opened[cell_tags], closed[cell_tags] - (kind[cell_tags] == _EMPTY)
    widths = np.diff(np.append(np.searchsorted(cell_tags, row_tags), len(cell_tags)))
    first = np.searchsorted(quotes, places)
    marks = np.searchsorted(quotes, ends) - first
    _require(((marks == 2) | (marks == 4) | (marks == 6)).all())
    begins, stops = quotes[first] + 1, quotes[first + 1]
    _require((begins == places + 6).all() and (buf[places + 3] == ord("r")).all() and (buf[places + 4] == ord("=")).all())
    # The address: one to three letters, then digits.
    columns = buf[begins].astype(np.int64) - 64
    _require(((columns >= 1) & (columns <= 26)).all())
    letters = np.ones(len(columns), np.int64)
    for i in (1, 2):
        letter = buf[np.minimum(begins + i, len(buf) - 1)].astype(np.int64) - 64
        own = (letters == i) & (letter >= 1) & (letter <= 26)
        columns[own] = columns[own] * 26 + letter[own]
        letters += own
    _require(only_digits(begins + letters, stops).all())
    rising = np.diff(columns) > 0
    row_firsts = (np.cumsum(widths) - widths)[widths > 0]
    rising[row_firsts[1:] - 1] = True
    _require(rising.all())

    styles, kind_begins, kind_ends = (np.zeros(len(columns), np.int64) for _ in range(3))
    last = stops.copy()
    for nth in (1, 2):
        own = np.flatnonzero(marks >= 2 * (nth + 1))
        if not len(own):
            continue
        at = last[own]
        begins, stops = quotes[first[own] + 2 * nth] + 1, quotes[first[own] + 2 * nth + 1]
        _require((buf[at + 1] == ord(" ")).all() and (buf[at + 3] == ord("=")).all() and (begins == at + 5).all())
        last[own] = stops
        name = buf[at + 2]
        # A style comes first, a type is the last one.
        is_style = name == ord("s")
        _require((is_style if nth == 1 else ~is_style)[marks[own] == 6].all())
        if not is_style.all():
            of_type = ~is_style
            _require((name[of_type] == ord("t")).all())
            kind_begins[own[of_type]], kind_ends[own[of_type]] = begins[of_type], stops[of_type]
            own, begins, stops = own[is_style], begins[is_style], stops[is_style]
        _require(only_digits(begins, stops).all())
        styles[own] = _whole(buf, begins, stops, _MOST_STYLE_DIGITS)
    _require((last + 1 == ends).all())

    # The last tag ends a row, so each cell has one behind it.
    valued = kind[cell_tags + 1] == _VALUE
    begins = np.where(valued, closed[cell_tags + 1] + 1, 0)
    ends = np.where(valued, opened[np.minimum(cell_tags + 2, len(opened) - 1)], 0)
    return StrictRows(data, numbers, starts, widths, columns, styles, begins, ends, kind_begins, kind_ends, only_digits(begins, ends))
