"""Cell expressions against plain Python on hand cases."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tabrecover.functions import text as X
from tabrecover.functions.tokens import plain, words

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"

TEXTS = [
    "", " ", "\t \n", "　 ", "Name", " Name ", "a  b", "a b", "<b>Role</b>", "Text\n(note)",
    "\n\n first \n second", "<br\n/>x", "<>kept", "a<b", "x\x1cy", "  <i> </i>\n\t", "Étè  Ünï cö", "=A1", "a\r\nb",
    *[f"{c}a{c}{c}b{c}" for c in SPACES],
]


def cleaned(text: str) -> str:
    untagged = re.sub("<[^>]+>", "", text)
    line = next((part for part in untagged.split("\n") if part.strip()), "")
    return " ".join(line.split())


def apply(spark, values, *columns):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return df.select("v", *columns).collect()


def test_clean_header_and_blank(spark):
    rows = apply(spark, TEXTS, X.clean_header(F.col("v")), X.is_blank(F.col("v")), X.trim_space(F.col("v")))
    for text, header, blank, trimmed in rows:
        assert header == cleaned(text), repr(text)
        assert blank == (text.strip() == ""), repr(text)
        assert trimmed == text.strip(), repr(text)
    assert apply(spark, [None], X.is_blank(F.col("v")), X.clean_header(F.col("v")))[0][1:] == (True, None)


def test_formula(spark):
    rows = apply(spark, ["=A1", " =A1", "", None, "a"], X.is_formula(F.col("v")), X.suppress_formula(F.col("v")))
    assert [r[1:] for r in rows] == [(True, None), (False, " =A1"), (False, ""), (False, None), (False, "a")]


@pytest.mark.parametrize(
    ("col", "letter"), [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (53, "BA"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")]
)
def test_column_letter(spark, col, letter):
    row = spark.range(1).select(X.column_letter(F.lit(col)), X.cell_ref(F.lit(12), F.lit(col))).first()
    assert tuple(row) == (letter, f"{letter}12")


def test_leading_number(spark):
    cases = {"0.9": 0.9, "95%": 95.0, "0.6x": 0.6, " .5 ": 0.5, "1e-1z": 0.1, "high": 0.0, "": 0.0, "-2": -2.0, "5.": 5.0}
    for text, number in apply(spark, cases, X.leading_number(F.col("v"))):
        assert number == cases[text]


def test_output_name(spark):
    cases = {"a/b.c/Book.v2.xlsx": "Book.v2-S", "plain": "plain-S", "x/.hidden": ".hidden-S"}
    for path, name in apply(spark, cases, X.output_name(F.col("v"), F.lit("S"))):
        assert name == cases[path]


def test_tokens(spark):
    rows = apply(spark, ["custName_2", "  ", "A--b a"], words(F.col("v")), plain(F.col("v")))
    assert rows[0][1] == ["2", "cust", "name"]
    assert rows[1][1:] == ([], "")
    assert rows[2][1:] == (["a", "b"], "a b a")
    assert rows[0][2] == "cust name 2"
