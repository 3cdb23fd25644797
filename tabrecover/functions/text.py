"""Expressions on the text of one cell or one header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters, with the four ASCII separators
# U+001C..U+001F. ``F.trim`` alone removes U+0020 only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same characters as ranges, without the plain space.
_OTHER_SPACE = r"\t-\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_SPACE_RUN = f"[ {_OTHER_SPACE}]+"
_TAG = "<[^>]+>"
# A text without any of these is its own cleaned header.
_UNCLEAN = f"[<{_OTHER_SPACE}]|  |^ | $"
_LEADING_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def is_blank(value: Column) -> Column:
    """True for null and for text made of whitespace only; never null."""
    return value.isNull() | (F.ltrim(F.coalesce(value, F.lit("")), F.lit(WHITESPACE)) == "")


def trim_space(value: Column) -> Column:
    """Drop whitespace of any kind from both ends."""
    return F.trim(value, F.lit(WHITESPACE))


def clean_header(raw: Column) -> Column:
    """Header text without tags: its first line with text, whitespace runs as one space.

    Gives "" when nothing is left, null for null.
    """
    untagged = F.ltrim(F.regexp_replace(raw, _TAG, ""), F.lit(WHITESPACE))
    line = F.regexp_replace(F.substring_index(untagged, "\n", 1), _SPACE_RUN, " ")
    return F.when(raw.rlike(_UNCLEAN), F.rtrim(line)).otherwise(raw)


def is_formula(value: Column) -> Column:
    """True for text which starts with "="; never null."""
    return F.coalesce(F.startswith(value, F.lit("=")), F.lit(False))


def suppress_formula(value: Column) -> Column:
    """The value, or null where it is formula text."""
    return F.when(~is_formula(value), value)


def leading_number(text: Column) -> Column:
    """The number a text starts with, 0.0 where there is none ("95%" gives 95.0)."""
    digits = F.regexp_extract(trim_space(text), _LEADING_NUMBER, 0)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("double"), F.lit(0.0))


def column_letter(col: Column) -> Column:
    """Letters of a 1-based column number: 1 is A, 27 is AA, 16384 is XFD."""
    zero = col.cast("int") - 1

    def letter(n: Column) -> Column:
        return F.char(F.lit(65) + n % 26)

    one = letter(zero)
    two = F.concat(letter(F.floor((zero - 26) / 26).cast("int")), one)
    three = F.concat(
        letter(F.floor((zero - 702) / 676).cast("int")),
        letter(F.floor((zero - 702) / 26).cast("int")),
        one,
    )
    return F.when(zero < 26, one).when(zero < 702, two).otherwise(three)


def cell_ref(row: Column, col: Column) -> Column:
    """Spreadsheet address of a cell, such as B12."""
    return F.concat(column_letter(col), row.cast("string"))


def file_stem(path: Column) -> Column:
    """Last path component without its extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def output_name(path: Column, sheet: Column) -> Column:
    """Name of the output made from one sheet: "<file stem>-<sheet>"."""
    return F.concat_ws("-", file_stem(path), sheet.cast("string"))
