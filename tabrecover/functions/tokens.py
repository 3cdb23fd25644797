"""Token sets of header names, used to find similar names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CASE_BREAK = r"(\p{Ll}|\p{N})(\p{Lu})"
_WORD_BREAK = r"[^\p{L}\p{N}]+"


def _parts(name: Column) -> Column:
    spaced = F.regexp_replace(name, _CASE_BREAK, "$1 $2")
    return F.filter(F.split(F.lower(spaced), _WORD_BREAK), lambda w: w != "")


def words(name: Column) -> Column:
    """Sorted set of lower-case words; "custName_2" gives [2, cust, name]."""
    return F.sort_array(F.array_distinct(_parts(name)))


def plain(name: Column) -> Column:
    """Lower-case words in their order with one space between; "custName_2" gives "cust name 2"."""
    return F.array_join(_parts(name), " ")
