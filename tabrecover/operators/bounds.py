"""Where the table of a sheet starts and ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabrecover.functions.text import is_blank
from tabrecover.grid import SHEET_KEYS
from tabrecover.plans.blocks import ROW_BLOCK, block_of, blocked, per_block

DEFAULT_TOLERANCE = 1

# A cell's place as one number, column first, rows counted backwards: the
# largest one is the first filled cell of the rightmost filled column. Hash
# aggregation with map-side combine works on it, so a sheet with a third of all
# rows costs one partial result per task.
_ROWS = 1 << 46


def sheet_bounds(grid: DataFrame, keys: Sequence[str] = SHEET_KEYS) -> DataFrame:
    """Header row of every sheet: first row filled in the rightmost filled column.

    Gives keys, sheet_idx, max_col (null without filled cells), header_row (then
    1), max_row (last row the sheet has, filled or not; 1 at least).
    """
    # The last filled cell of a row counts; it is the last cell as a rule, and only else the others are looked at.
    values = F.col("cells.value")
    filled = F.array_max(F.transform(values, lambda v, i: F.when(~is_blank(v), i + 1)))
    width = F.when(~is_blank(F.get(values, F.size(values) - 1)), F.size(values)).otherwise(filled)
    place = width.cast("long") * F.lit(_ROWS) - F.col("row")
    bounds = grid.select(*keys, "sheet_idx", "row", place.alias("_place")).groupBy(*keys).agg(
        F.min("sheet_idx").alias("sheet_idx"),
        F.max("_place").alias("_place"),
        F.greatest(F.max("row"), F.lit(1)).alias("max_row"),
    )
    max_col = F.shiftright("_place", 46) + 1
    return bounds.select(
        *keys,
        "sheet_idx",
        max_col.cast("int").alias("max_col"),
        F.coalesce(max_col * F.lit(_ROWS) - F.col("_place"), F.lit(1)).alias("header_row"),
        "max_row",
    )


def table_end(
    grid: DataFrame,
    bounds: DataFrame,
    tolerance: int = DEFAULT_TOLERANCE,
    keys: Sequence[str] = SHEET_KEYS,
    row_block: int = ROW_BLOCK,
    tasks: int | None = None,
) -> DataFrame:
    """Add table_end_row to the bounds.

    It is the first filled row, from the header row on, of the rightmost filled
    column that is followed by ``tolerance`` blank rows in that column; rows
    past the end of the sheet count as blank. A grid that has its blocks (``land_grid``) is read where it is:
    its blocks are cut into smaller ones of ``row_block`` rows and put together again before anything is sent on. ``tasks`` deals
    the rows of any other grid to so many tasks.
    """
    keys = list(keys)
    placed = "block" in grid.columns and ROW_BLOCK % row_block == 0
    size = ROW_BLOCK if placed else row_block
    edges = per_block(
        bounds.filter("max_col is not null").select(*keys, "max_col", "header_row", "max_row"),
        F.col("header_row"),
        F.col("max_row"),
        size,
    )
    filled = F.transform(F.col("cells.value"), lambda v: ~is_blank(v))
    rows = blocked(grid, size).select(*keys, "row", "block", filled.alias("filled"))
    rows = rows.repartition(tasks, *keys, "block") if tasks and not placed else rows
    edge_rows = (
        rows.join(edges.drop("max_row"), [*keys, "block"])
        .filter((F.col("row") >= F.col("header_row")) & F.get("filled", F.col("max_col") - 1))
        .select(*keys, "block", block_of(F.col("row"), row_block).alias("part"), "row")
    )

    in_part = Window.partitionBy(*keys, "block", "part").orderBy("row")
    gap = F.lead("row").over(in_part) - F.col("row")
    blocks = (
        edge_rows.withColumn("gap", gap)
        .groupBy(*keys, "block", "part")
        .agg(
            F.min("row").alias("first"),
            F.max("row").alias("last"),
            F.min(F.when(F.col("gap") > tolerance, F.col("row"))).alias("stop"),
        )
    )

    def stop(following: Column, at_end: Column) -> Column:
        return F.min(F.coalesce("stop", F.when(following > tolerance, F.col("last")), at_end)).alias("stop")

    if placed:
        across_parts = Window.partitionBy(*keys, "block").orderBy("part")
        blocks = (
            blocks.withColumn("following", F.lead("first").over(across_parts) - F.col("last"))
            .groupBy(*keys, "block")
            .agg(F.min("first").alias("first"), F.max("last").alias("last"), stop(F.col("following"), F.lit(None)))
        )
    across = Window.partitionBy(*keys).orderBy("block")
    following = F.lead("first").over(across) - F.col("last")
    ends = (
        blocks.withColumn("following", following)
        .groupBy(*keys)
        .agg(stop(F.col("following"), F.when(F.col("following").isNull(), F.col("last"))))
        .withColumnRenamed("stop", "table_end_row")
    )
    return bounds.join(ends, keys, "left").withColumn(
        "table_end_row", F.coalesce("table_end_row", "header_row")
    )
