"""The grid: one row per sheet row, with the cells as a dense array.

    file STRING, sheet_idx BIGINT, sheet STRING, row BIGINT (1-based),
    cells ARRAY<STRUCT<value STRING, dtype STRING, number_format STRING>>

Element ``i`` of ``cells`` is column ``i + 1`` (null where the sheet has no
cell), so a known column is one array access and projecting a sheet to a target
layout needs no shuffle of cells and no pivot. ``dtype`` is one of s (text),
n (number), d (date), b (boolean), e (error), f (formula kept as text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHEET_KEYS = ("file", "sheet")

CELL_TYPE = "struct<value:string,dtype:string,number_format:string>"
GRID_SCHEMA = f"file string, sheet_idx bigint, sheet string, row bigint, cells array<{CELL_TYPE}>"


def by_name(names: Sequence[str]) -> list[Column]:
    """Columns by their exact names; a header may hold dots and backticks."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def cell(value: Column, dtype: str | Column = "s", number_format: str | Column = "General") -> Column:
    """One cell; null where the value is null."""
    dtype = F.lit(dtype) if isinstance(dtype, str) else dtype
    number_format = F.lit(number_format) if isinstance(number_format, str) else number_format
    made = F.struct(
        value.cast("string").alias("value"),
        dtype.alias("dtype"),
        number_format.alias("number_format"),
    ).cast(CELL_TYPE)
    return F.when(value.isNotNull(), made)


def grid_to_cells(grid: DataFrame, keys: Sequence[str] = SHEET_KEYS) -> DataFrame:
    """Long form, one row per cell that has a value: keys, row, col, value, dtype, number_format."""
    long = grid.select(*keys, "row", F.posexplode("cells").alias("pos", "cell"))
    return long.filter(F.col("cell.value").isNotNull()).select(
        *keys, "row", (F.col("pos") + 1).alias("col"), "cell.*"
    )


def cells_to_grid(cells: DataFrame, keys: Sequence[str] = SHEET_KEYS) -> DataFrame:
    """Collect long cells into sheet rows; a group is one row of one sheet."""
    body = F.struct("value", "dtype", "number_format").cast(CELL_TYPE)
    grouped = cells.groupBy(*keys, "row").agg(
        F.max("col").alias("_width"),
        F.map_from_entries(F.collect_list(F.struct(F.col("col").cast("int"), body))).alias("_by_col"),
    )
    dense = F.transform(
        F.sequence(F.lit(1), F.col("_width").cast("int")),
        lambda c: F.try_element_at(F.col("_by_col"), c),
    )
    return grouped.select(*keys, F.col("row").cast("bigint").alias("row"), dense.alias("cells"))
