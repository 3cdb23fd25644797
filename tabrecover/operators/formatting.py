"""Projection of every sheet to one target layout.

A sheet's plan is one row: which input column feeds each target column. Grid
rows meet the plan of their sheet once, keyed by (sheet, row block), and each
target column is then one array access. No cell is shuffled on its own, nothing
is pivoted, and a sheet with a third of all rows is cut into its row blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabrecover.functions.text import is_blank, is_formula, suppress_formula
from tabrecover.grid import SHEET_KEYS, by_name
from tabrecover.plans.blocks import ROW_BLOCK, block_of, blocked, per_block
from tabrecover.plans.checkpoints import stored, tasks_for
from tabrecover.plans.joins import lookup_join

MAX_COLUMNS = 16_384


@dataclass(frozen=True)
class Layout:
    """Target columns in sheet order; "" marks a column without a name."""

    targets: tuple[str, ...]
    header_row: int = 1

    @staticmethod
    def of(layout: DataFrame, header_row: int = 1) -> Layout:
        """Read the layout table (target, target_col); it has one row per template column."""
        rows = layout.orderBy("target_col").limit(MAX_COLUMNS + 1).collect()
        if len(rows) > MAX_COLUMNS:
            raise ValueError(f"a layout has {MAX_COLUMNS} columns at most")
        return Layout(tuple(r.target for r in rows), header_row)

    @property
    def named(self) -> list[tuple[int, str]]:
        """Positions (from 0) and names of the columns which have one."""
        return [(i, t) for i, t in enumerate(self.targets) if t]

    @property
    def columns(self) -> list[str]:
        """Output column names: the target names, with the position added to repeated ones.

        Names are compared without case, as Spark resolves them.
        """
        seen: set[str] = {"file", "sheet", "target_row"}
        out = []
        for i, name in self.named:
            while name.lower() in seen:
                name = f"{name}_{i + 1}"
            seen.add(name.lower())
            out.append(name)
        return out

    def table(self, df: DataFrame) -> DataFrame:
        """Distinct target names as a DataFrame in the session of ``df``."""
        names = sorted({t for _, t in self.named})
        return df.sparkSession.createDataFrame([(n,) for n in names], "target string")


def applicable_mappings(
    headers: DataFrame, normalized: DataFrame, layout: Layout, keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """Per sheet and target the first input header that maps to it and is not ignored.

    ``headers`` comes from ``input_headers``. Gives keys, target, header, value_col.
    """
    edges = normalized.filter("not is_ignored and target is not null")
    edges = edges.join(layout.table(normalized), "target", "left_semi")
    edges = edges.select(F.col("scanned").alias("header"), "target")
    matched = lookup_join(headers, edges, ["header"])
    return matched.groupBy(*keys, "target").agg(
        F.min_by("header", "first_col").alias("header"),
        F.min_by("value_col", "first_col").alias("value_col"),
    )


def uncovered_targets(
    bounds: DataFrame, applicable: DataFrame, layout: Layout, keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """Per sheet the targets no input header maps to: keys, target."""
    names = sorted({t for _, t in layout.named})
    # One row per sheet is joined; a sheet has no more targets than the layout.
    covered = applicable.groupBy(*keys).agg(F.collect_set("target").alias("covered"))
    none = F.array().cast("array<string>")
    wanted = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    missing = F.filter(wanted, lambda n: ~F.array_contains(F.coalesce("covered", none), n))
    return bounds.select(*keys).join(covered, list(keys), "left").select(*keys, F.explode(missing).alias("target"))


def sheet_plans(
    bounds: DataFrame, applicable: DataFrame, layout: Layout, keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """One row per sheet: its bounds and input_cols, the source column of each named target.

    Two target columns with one name get the same source; null means uncovered.
    """
    keys = list(keys)
    place = {name: f"_{k}" for k, name in enumerate(dict.fromkeys(t for _, t in layout.named))}
    sources = applicable.groupBy(*keys).agg(
        *[F.max(F.when(F.col("target") == name, F.col("value_col"))).alias(c) for name, c in place.items()]
    )
    cols = [F.col(place[name]) for _, name in layout.named]
    return bounds.join(sources, keys, "left").select(
        *bounds.columns, F.array(*cols).cast("array<int>").alias("input_cols")
    )


def project_cells(
    grid: DataFrame,
    plans: DataFrame,
    layout: Layout,
    keys: Sequence[str] = SHEET_KEYS,
    stop_at_table_end: bool = False,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """Rows below the header with the source cell of each named target, nothing dropped yet.

    Gives keys, block (of the input row), target_row and picked, an array of
    cells in the order of ``layout.named``. Rows go on to the end of the sheet;
    ``stop_at_table_end`` leaves footers out and needs plans with table_end_row.
    A grid stored in buckets by sheet and block is not shuffled.
    """
    picked = F.transform("input_cols", lambda c: F.get("cells", c - 1))
    return _project(grid, "cells", picked, plans, layout, keys, stop_at_table_end, row_block)


def project_values(
    grid: DataFrame,
    plans: DataFrame,
    layout: Layout,
    keys: Sequence[str] = SHEET_KEYS,
    stop_at_table_end: bool = False,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """As ``project_cells``, with the texts only, formulas left empty; reads no other part of
    the cells."""
    picked = F.transform("input_cols", lambda c: suppress_formula(F.get("cells", c - 1)))
    return _project(grid, "cells.value", picked, plans, layout, keys, stop_at_table_end, row_block)


def _project(
    grid: DataFrame,
    cells: str,
    picked: Column,
    plans: DataFrame,
    layout: Layout,
    keys: Sequence[str],
    stop_at_table_end: bool,
    row_block: int,
) -> DataFrame:
    # The picked cells stay one array: an expression per target column would make
    # generated methods too long to be compiled, from ten columns on.
    keys = list(keys)
    last_row = "table_end_row" if stop_at_table_end else "max_row"
    spread = per_block(plans, F.col("header_row"), F.col(last_row), row_block)
    spread = spread.select(*keys, "block", "header_row", F.col(last_row).alias("last_row"), "input_cols")
    rows = blocked(grid, row_block).select(*keys, "block", "row", F.col(cells).alias("cells"))
    body = rows.join(spread, [*keys, "block"]).filter("row > header_row and row <= last_row")
    target_row = F.lit(layout.header_row) + F.col("row") - F.col("header_row")
    return body.select(*keys, "block", target_row.alias("target_row"), picked.alias("picked"))


def as_columns(projected: DataFrame, layout: Layout) -> DataFrame:
    """One column per named target in place of the picked array."""
    columns = [F.get("picked", F.lit(k)).alias(name) for k, name in enumerate(layout.columns)]
    return projected.select(*[c for c in projected.columns if c != "picked"], *columns)


def has_data(values: Column) -> Column:
    """True for an array with any text that is neither blank nor a formula."""
    return F.exists(values, lambda v: ~is_blank(v) & ~is_formula(v))


def drop_empty_rows(projected: DataFrame) -> DataFrame:
    """Keep the rows with data in any of the picked texts."""
    return projected.filter(has_data(F.col("picked")))


def renumber_rows(
    rows: DataFrame, first_row: int, long_blocks: DataFrame, keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """Close the gaps in target_row: rows of each sheet get first_row, first_row + 1, ...

    Rows are numbered within their block, which uses the placement the rows have
    from the join with their plan. Where a sheet has several blocks (listed in
    ``long_blocks``: keys, block), those are counted and their counts added up;
    all other rows are read once only.
    """
    at = [*keys, "block"]
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.join(long_blocks, at, "left_semi")
        .groupBy(*at)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    place = F.row_number().over(Window.partitionBy(*at).orderBy("target_row")) - 1 + first_row
    return (
        rows.withColumn("_place", place)
        .join(starts, at, "left")
        .withColumn("target_row", (F.col("_place") + F.coalesce("_start", F.lit(0))).cast("bigint"))
        .select(*by_name(rows.columns))
    )


def long_sheet_blocks(
    bounds: DataFrame, keys: Sequence[str] = SHEET_KEYS, row_block: int = ROW_BLOCK
) -> DataFrame:
    """Blocks of the sheets with more rows than one block: keys, block."""
    long = bounds.filter(F.col("max_row") > row_block)
    return per_block(long, F.lit(1), F.col("max_row"), row_block).select(*keys, "block")


def format_extent(
    bounds: DataFrame, layout: Layout, template_rows: int = 0, keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """Last row of each output before rows are dropped: keys, last_target_row."""
    needed = F.lit(layout.header_row) + F.col("max_row") - F.col("header_row")
    return bounds.select(
        *keys, F.greatest(F.lit(template_rows), needed).cast("bigint").alias("last_target_row")
    )


def fill_rows(
    formatted: DataFrame,
    extent: DataFrame,
    layout: Layout,
    keys: Sequence[str] = SHEET_KEYS,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """Add a row of nulls for every row up to the extent that the input sheet lacks."""
    keys = list(keys)
    first = F.lit(layout.header_row + 1)
    filled = extent.filter(F.col("last_target_row") >= first)
    blocks = per_block(filled, first, F.col("last_target_row"), row_block)
    start = F.greatest(first.cast("long"), F.col("block") * row_block + 1)
    stop = F.least(F.col("last_target_row"), (F.col("block") + 1) * row_block)
    # a shuffle between the two steps, or all blocks of a sheet unfold in one task
    spread = blocks.repartition(*keys, "block")
    every_row = spread.select(*keys, F.explode(F.sequence(start, stop)).alias("target_row"))
    rows = filled.agg(F.coalesce(F.sum("last_target_row"), F.lit(0))).first()[0]
    every_row = every_row.repartition(tasks_for(extent.sparkSession, rows), *keys, "target_row")
    return every_row.join(formatted, [*keys, "target_row"], "left").select(*by_name(formatted.columns))


def format_sheets(
    grid: DataFrame,
    plans: DataFrame,
    layout: Layout,
    keys: Sequence[str] = SHEET_KEYS,
    drop_empty: bool = True,
    renumber: bool = True,
    stop_at_table_end: bool = False,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """All sheets in the target layout: keys, target_row, one text column per named target.

    ``drop_empty`` removes rows without data and, with ``renumber``, closes the
    gaps; ``renumber=False`` keeps the aligned row numbers. Without
    ``drop_empty`` every row down to the extent is there.
    """
    rows = project_values(grid, plans, layout, keys, stop_at_table_end, row_block)
    if not drop_empty:
        extent = format_extent(plans, layout, keys=keys)
        return as_columns(fill_rows(rows.drop("block"), extent, layout, keys, row_block), layout)
    kept = drop_empty_rows(rows)
    if renumber:
        kept = renumber_rows(kept, layout.header_row + 1, long_sheet_blocks(plans, keys, row_block), keys)
    return as_columns(kept.drop("block"), layout)


def project_once(
    grid: DataFrame,
    plans: DataFrame,
    layout: Layout,
    keys: Sequence[str] = SHEET_KEYS,
    stop_at_table_end: bool = False,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """``project_cells`` with all that later steps need, so that the grid is read once: texts (formulas left
    empty), has_data, and place, the number of rows with data before this one in its block.

    Rows are numbered where the join with their plan has put them. Store the result: the types, the summary and
    ``format_projected`` read it without a shuffle.
    """
    cells = project_cells(grid, plans, layout, keys, stop_at_table_end, row_block)
    cells = cells.withColumn("texts", F.transform(F.col("picked.value"), suppress_formula))
    cells = cells.withColumn("has_data", has_data(F.col("texts")))
    before = Window.partitionBy(*keys, "block").orderBy("target_row").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("place", F.coalesce(F.count_if("has_data").over(before), F.lit(0)))


def format_projected(
    projected: DataFrame,
    plans: DataFrame,
    layout: Layout,
    keys: Sequence[str] = SHEET_KEYS,
    drop_empty: bool = True,
    renumber: bool = True,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """``format_sheets`` from a stored ``project_once``: rows are filtered and numbered in place.

    Only the blocks of sheets with several of them are counted, and their counts joined.
    """
    rows = projected.withColumn("picked", F.col("texts"))
    if not drop_empty:
        extent = format_extent(plans, layout, keys=keys)
        rows = rows.select(*keys, "target_row", "picked")
        return as_columns(fill_rows(rows, extent, layout, keys, row_block), layout)
    kept = rows.filter("has_data")
    if renumber:
        at = [*keys, "block"]
        before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        counts = lookup_join(kept.select(*at), long_sheet_blocks(plans, keys, row_block), at, "left_semi")
        counts = counts.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
        starts = stored(counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
        kept = lookup_join(kept, starts, at, "left")
        number = F.col("place") + F.coalesce("_start", F.lit(0)) + layout.header_row + 1
        kept = kept.withColumn("target_row", number.cast("bigint"))
    return as_columns(kept.select(*keys, "target_row", "picked"), layout)


def template_overlay(
    formatted: DataFrame,
    template: DataFrame,
    bounds: DataFrame,
    layout: Layout,
    keys: Sequence[str] = SHEET_KEYS,
    drop_empty: bool = True,
    row_block: int = ROW_BLOCK,
) -> DataFrame:
    """Formatted rows together with the template's own cells.

    Kept of the template: the rows down to its header row, and below it the
    cells of columns without a name. ``formatted`` holds aligned row numbers
    (``renumber=False``); ``template`` is a grid of one sheet. Columns without a
    name are called column_1, column_2, ... by their position.
    """
    keys = list(keys)
    width = len(layout.targets)
    names = dict(zip([i for i, _ in layout.named], layout.columns))
    out = [names.get(i, f"column_{i + 1}") for i in range(width)]
    if len({n.lower() for n in out}) < width:
        raise ValueError("a target is named like a column without a name")
    texts = F.col("cells.value")
    named = F.array(*[F.lit(i in names) for i in range(width)])
    below = F.col("row") > layout.header_row
    shown = F.transform(named, lambda is_named, i: F.when(~(is_named & below), F.get(texts, i)))
    static = template.select(F.col("row").alias("target_row"), shown.alias("static"))

    last = template.agg(F.max("row")).first()[0] or layout.header_row
    blocks = per_block(bounds.select(*keys), F.lit(1), F.lit(last), row_block)
    start = F.col("block") * row_block + 1
    rows = F.sequence(start, F.least(F.lit(last).cast("long"), start + (row_block - 1)))
    copies = lookup_join(
        blocks.select(*keys, F.explode(rows).alias("target_row")), static, ["target_row"]
    )
    ends = bounds.agg(F.coalesce(F.sum(F.col("max_row") + last), F.lit(0))).first()[0]
    copies = copies.repartition(tasks_for(bounds.sparkSession, ends), *keys, "target_row")
    empty = F.lit(None).cast("string")
    own = F.array(*[by_name([names[i]])[0] if i in names else empty for i in range(width)])
    both = copies.join(
        formatted.select(*keys, "target_row", own.alias("own")), [*keys, "target_row"], "full_outer"
    )
    nothing = F.array(*[empty] * width)
    merged = both.select(
        *keys,
        "target_row",
        F.zip_with(F.coalesce("own", nothing), F.coalesce("static", nothing), lambda o, t: F.coalesce(o, t)).alias("picked"),
    )
    if drop_empty:
        kept = merged.filter((F.col("target_row") == layout.header_row) | has_data(F.col("picked")))
        kept = kept.withColumn("block", block_of(F.col("target_row"), row_block))
        extent = format_extent(bounds, layout, last, keys).withColumnRenamed("last_target_row", "max_row")
        merged = renumber_rows(kept, 1, long_sheet_blocks(extent, keys, row_block), keys)
    columns = [F.get("picked", F.lit(i)).alias(name) for i, name in enumerate(out)]
    return merged.select(*keys, "target_row", *columns)
