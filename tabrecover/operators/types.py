"""Cell types and number formats of the target columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrecover.functions.text import is_blank, is_formula
from tabrecover.grid import SHEET_KEYS, by_name
from tabrecover.operators.formatting import Layout

GENERAL = "General"

# What a value is, judged by its text: a whole number, one beyond the whole numbers a
# double holds exactly, a number with a fraction that a double holds, one with an exponent that
# a double holds, a number with a fraction that only decimals hold, a date with a time, a truth value, text.
WHOLE, LARGE, REAL, POWER, EXACT, DATE, TRUTH, TEXT = "whole", "large", "real", "power", "exact", "date", "truth", "text"
_EXACT = 1 << 53
_MAX_DIGITS = 38


def _digits(number: Column) -> Column:
    """Digits of a number's text that count, whatever its exponent."""
    mantissa = F.regexp_replace(number, "[eE].*$", "")
    return F.regexp_replace(F.regexp_replace(mantissa, "[^0-9]", ""), "^0+|0+$", "")


def value_kind(value: Column, dtype: Column) -> Column:
    """Kind of a cell; whatever a cast to the kind's type would lose or change is text.

    A double holds a number if the shortest text that it is read back from has the number's
    own digits. Times of a day and lengths of time are text: they are no point in time.
    """
    double = value.try_cast("double")
    held = _digits(value) == _digits(double.cast("string"))
    whole = value.try_cast("bigint")
    number = (
        F.when(
            value.rlike(r"^-?\d{1,18}$") & (whole.cast("string") == value),
            F.when(F.abs(whole) <= _EXACT, WHOLE).otherwise(LARGE),
        )
        .when(value.rlike(r"^-?\d+$"), TEXT)
        .when(value.rlike(r"^-?\d+\.\d+$"), F.when(held, REAL).otherwise(EXACT))
        .when(double.isNotNull() & held, POWER)
        .otherwise(TEXT)
    )
    is_date = value.rlike(r"^\d{4}-\d{2}-\d{2} \d") & value.try_cast("timestamp_ntz").isNotNull()
    return (
        F.when(dtype == "n", number)
        .when(dtype == "d", F.when(is_date, DATE).otherwise(TEXT))
        .when(dtype == "b", F.when(F.upper(value).isin("TRUE", "FALSE"), TRUTH).otherwise(TEXT))
        .otherwise(TEXT)
    )


def column_profile(projected: DataFrame, layout: Layout) -> DataFrame:
    """How often each kind of value and number format occurs: target, kind, number_format, cells,
    the most digits before and after the point (before_point, after_point; 0 without any), and the
    fewest after it (least_after).

    ``projected`` comes from ``project_cells``; blank and formula cells do not count.
    """
    cells = projected.select(F.posexplode("picked").alias("pos", "cell")).select("pos", "cell.*")
    copied = cells.filter(~is_blank(F.col("value")) & ~is_formula(F.col("value")))
    kind = value_kind(F.col("value"), F.col("dtype")).alias("kind")
    parts = F.split(F.regexp_replace("value", "^-?0*", ""), r"\.")
    after = F.coalesce(F.length(F.get(parts, F.lit(1))), F.lit(0))
    counts = copied.groupBy("pos", kind, "number_format").agg(
        F.count(F.lit(1)).alias("cells"),
        F.max(F.length(F.get(parts, F.lit(0)))).alias("before_point"),
        F.max(after).alias("after_point"),
        F.min(after).alias("least_after"),
    )
    names = F.array(*[F.lit(c) for c in layout.columns])
    return counts.select(
        F.get(names, F.col("pos")).alias("target"), "kind", "number_format", "cells", "before_point", "after_point", "least_after"
    )


def column_formats(profile: DataFrame) -> DataFrame:
    """Per target: column_type, and the most used number format that is not General.

    A column gets the type that holds every one of its values, else it is text. Numbers that doubles
    do not hold are decimals if all have the same digits after the point, so that no text changes.
    Ties go to the first format in byte order; null where all cells are General.
    """
    by_format = profile.groupBy("target", "number_format").agg(F.sum("cells").alias("cells"))
    shaped = F.when(
        F.col("number_format") != GENERAL, F.struct((-F.col("cells")).alias("cells"), "number_format")
    )
    formats = by_format.groupBy("target").agg(F.min(shaped).alias("top"))
    def only(*kinds: str) -> Column:
        return F.bool_and(F.col("kind").isin(*kinds))

    scale = F.max("after_point")
    digits = F.greatest(F.max("before_point") + scale, F.lit(1))
    column_type = (
        F.when(only(WHOLE, LARGE), "bigint")
        .when(only(WHOLE, REAL, POWER), "double")
        .when(
            only(REAL, EXACT) & (digits <= _MAX_DIGITS) & (scale == F.min("least_after")),
            F.format_string("decimal(%d,%d)", digits, scale),
        )
        .when(only(DATE), "timestamp_ntz")
        .when(only(TRUTH), "boolean")
        .otherwise("string")
    )
    kinds = profile.groupBy("target").agg(column_type.alias("column_type"), F.sum("cells").alias("cells"))
    return kinds.join(formats, "target").select(
        "target", "column_type", F.col("top.number_format").alias("number_format"), "cells"
    )


def column_types(formats: DataFrame) -> dict[str, str]:
    """Types by target column; one row per column of the layout is read."""
    return {r.target: r.column_type for r in formats.select("target", "column_type").collect()}


def typed_rows(
    formatted: DataFrame, types: dict[str, str], keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """Cast the text columns to their types; blank text in a typed column becomes null."""
    fixed = [*keys, "target_row"]
    names = [c for c in formatted.columns if c not in fixed]
    cast = [
        col.try_cast(types[c]).alias(c) if types.get(c, "string") != "string" else col
        for c, col in zip(names, by_name(names))
    ]
    return formatted.select(*fixed, *cast)
