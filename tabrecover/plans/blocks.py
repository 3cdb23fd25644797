"""Row blocks: a key that cuts sheets of any length into bounded pieces.

A sheet made from a table may hold a third of all rows. Work that needs the
rows of a sheet together (a join with facts of the sheet, numbering, looking
ahead) is keyed by ``(sheet, block)``, where a block is a fixed range of row
numbers, and the blocks of a sheet are joined up from one small row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_BLOCK = 1 << 17


def block_of(row: Column, size: int = ROW_BLOCK) -> Column:
    """Block number of a 1-based row number."""
    return F.floor((row - 1) / F.lit(size)).cast("long")


def blocked(grid: DataFrame, size: int = ROW_BLOCK) -> DataFrame:
    """The grid with its block column; a stored grid has it already (see ``land_grid``)."""
    if "block" in grid.columns and size == ROW_BLOCK:
        return grid
    return grid.withColumn("block", block_of(F.col("row"), size))


def per_block(
    sheets: DataFrame, first_row: Column, last_row: Column, size: int = ROW_BLOCK
) -> DataFrame:
    """Repeat each sheet's row for every block from ``first_row`` to ``last_row``."""
    span = F.sequence(block_of(first_row, size), block_of(F.greatest(first_row, last_row), size))
    return sheets.withColumn("block", F.explode(span))
