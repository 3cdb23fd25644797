"""Tables as sheets, so that any Spark input can enter the same operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrecover.grid import by_name, cell
from tabrecover.plans.positions import with_position


def _dtype(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "n"
    if isinstance(kind, T.BooleanType):
        return "b"
    return "d" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "s"


def table_to_grid(
    df: DataFrame,
    file: Column,
    sheet: Column,
    columns: Sequence[str],
    row: Column | None = None,
    order: Sequence[str] = (),
    sheet_idx: Column | None = None,
) -> DataFrame:
    """Sheets with the column names in row 1 and one row per table row below.

    ``row`` is the 1-based number of the table row in its sheet, unique there;
    gaps are blank rows. Without it all rows are numbered in the given order.
    """
    if row is None:
        df = with_position(df, order, "_pos")
        row = F.col("_pos") + 1
    sheet_idx = F.lit(0) if sheet_idx is None else sheet_idx
    keys = [
        file.cast("string").alias("file"),
        sheet_idx.cast("bigint").alias("sheet_idx"),
        sheet.cast("string").alias("sheet"),
    ]
    kinds = {f.name: _dtype(f.dataType) for f in df.schema.fields}
    cells = F.array(*[cell(col, kinds[c]) for c, col in zip(columns, by_name(columns))])
    body = df.select(*keys, (row + 1).cast("bigint").alias("row"), cells.alias("cells"))
    names = F.array(*[cell(F.lit(c)) for c in columns])
    heads = df.select(*keys).distinct()
    return body.unionByName(
        heads.select("*", F.lit(1).cast("bigint").alias("row"), names.alias("cells"))
    )
