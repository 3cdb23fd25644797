"""Header cells of every sheet, the distinct header set and the scan statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrecover.functions.text import clean_header, trim_space
from tabrecover.grid import SHEET_KEYS
from tabrecover.plans.blocks import block_of, blocked
from tabrecover.plans.joins import fits_broadcast

EMPTY, EMPTIED, CLEANED, AS_IS = "empty", "emptied", "cleaned", "as_is"


def sheet_headers(grid: DataFrame, bounds: DataFrame, keys: Sequence[str] = SHEET_KEYS) -> DataFrame:
    """Cells of the detected header row, left to right, up to its last cell with text.

    Gives keys, sheet_idx, row, col, text, dtype. Bounds are joined by sheet and row
    block: a grid stored in buckets (``sinks.land_grid``) stays where it is, and
    only the blocks that hold a header row take part.
    """
    at = [*keys, "block"]
    header_rows = bounds.select(*keys, block_of(F.col("header_row")).alias("block"), "header_row")
    # Written as a difference, or the optimiser would take the row as a join key and deal the grid out anew.
    found = blocked(grid).join(header_rows, at).filter(F.col("row") - F.col("header_row") == 0)
    filled_at = F.transform(
        F.col("cells.value"), lambda v, i: F.when(F.coalesce(v, F.lit("")) != "", i + 1).otherwise(0)
    )
    shortened = F.slice("cells", F.lit(1), F.coalesce(F.array_max(filled_at), F.lit(0)))
    last = F.get(F.col("cells.value"), F.size("cells") - 1)
    cells = F.when(F.coalesce(last, F.lit("")) != "", F.col("cells")).otherwise(shortened)
    return found.select(*keys, "sheet_idx", "row", F.posexplode(cells).alias("pos", "cell")).select(
        *keys,
        "sheet_idx",
        "row",
        (F.col("pos") + 1).alias("col"),
        F.col("cell.value").alias("text"),
        F.col("cell.dtype").alias("dtype"),
    )


def clean_headers(headers: DataFrame) -> DataFrame:
    """Add raw (trimmed text), header (cleaned; null where nothing is left) and class."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = (
        F.when(F.col("raw") == "", EMPTY)
        .when(F.col("header").isNull(), EMPTIED)
        .when(F.col("header") != F.col("raw"), CLEANED)
        .otherwise(AS_IS)
    )
    return (
        headers.withColumn("raw", trim_space(text))
        .withColumn("header", F.nullif(clean_header(text), F.lit("")))
        .withColumn("class", kind)
    )


def scan_order(path: str = "file") -> Column:
    """Sort key of a directory walk: path components compared level by level."""
    return F.split(F.col(path), "/")


def scanned_headers(headers: DataFrame) -> DataFrame:
    """Distinct cleaned headers in byte order."""
    return headers.filter("header is not null").select("header").distinct().orderBy("header")


def header_provenance(headers: DataFrame, keys: Sequence[str] = SHEET_KEYS) -> DataFrame:
    """Per header: where it was seen first and the first text that cleaning changed into it.

    Gives header, first_file, first_sheet, first_row, first_col, first_original
    (null where no text was changed) and occurrences.
    """
    file, sheet = keys
    at = F.struct(
        scan_order(file).alias("walk"),
        F.col("sheet_idx"),
        F.col("col"),
        F.col("row"),
        F.col(file).alias("file"),
        F.col(sheet).alias("sheet"),
    )
    changed = F.when(F.col("raw") != F.col("header"), F.struct(at.alias("at"), F.col("raw")))
    first = (
        headers.filter("header is not null")
        .groupBy("header")
        .agg(
            F.min(at).alias("at"),
            F.min(changed).alias("changed"),
            F.count(F.lit(1)).alias("occurrences"),
        )
    )
    return first.select(
        "header",
        F.col("at.file").alias("first_file"),
        F.col("at.sheet").alias("first_sheet"),
        F.col("at.row").alias("first_row"),
        F.col("at.col").alias("first_col"),
        F.col("changed.raw").alias("first_original"),
        "occurrences",
    )


def mark_first_seen(
    headers: DataFrame, provenance: DataFrame, keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """Add is_new: true for the first occurrence of a header in scan order.

    Joined on the full place of the occurrence, never on the header alone, so a
    header with a third of all occurrences does not meet in one task.
    """
    file, sheet = keys
    first = provenance.select(
        "header",
        F.col("first_file").alias(file),
        F.col("first_sheet").alias(sheet),
        F.col("first_col").alias("col"),
        F.lit(True).alias("_first"),
    )
    # Distinct headers are few as a rule; then the occurrences stay where they are.
    first = F.broadcast(first) if fits_broadcast(first) else first
    marked = headers.join(first, ["header", file, sheet, "col"], "left")
    return marked.withColumn(
        "is_new", F.when(F.col("header").isNotNull(), F.coalesce("_first", F.lit(False)))
    ).drop("_first")


def sheet_scan_stats(
    bounds: DataFrame, headers: DataFrame, keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """Per sheet: headers found, empty, changed by cleaning, and all cells of the header row."""
    keys = list(keys)
    counts = headers.groupBy(*keys).agg(
        F.count("header").alias("headers_found"),
        F.count_if(F.col("class").isin(EMPTY, EMPTIED)).alias("empty_headers"),
        F.count_if(F.col("class") == CLEANED).alias("cleaned_headers"),
        F.count(F.lit(1)).alias("raw_headers"),
    )
    measures = ["headers_found", "empty_headers", "cleaned_headers", "raw_headers"]
    return bounds.select(*keys, "header_row").join(counts, keys, "left").fillna(0, measures)


def sheets_without_valid_headers(sheet_stats: DataFrame) -> DataFrame:
    """Sheets whose header row has cells, none of them usable."""
    return sheet_stats.filter("headers_found = 0 and raw_headers > 0")


def file_scan_stats(
    sheet_stats: DataFrame, rejects: DataFrame | None = None, file: str = "file"
) -> DataFrame:
    """Per file: sheets read, sheets with errors, headers found, empty headers, and has_error.

    ``rejects`` holds (file, sheet, reason) rows; a null sheet stands for a file
    that could not be opened at all. Such a file is listed with zero counts.
    """
    good = sheet_stats.select(
        file,
        F.lit(1).alias("ok"),
        F.lit(0).alias("bad"),
        "headers_found",
        "empty_headers",
        F.lit(False).alias("broken"),
    )
    if rejects is not None:
        bad = rejects.select(
            file,
            F.lit(0).alias("ok"),
            F.when(F.col("sheet").isNotNull(), 1).otherwise(0).alias("bad"),
            F.lit(0).cast("bigint").alias("headers_found"),
            F.lit(0).cast("bigint").alias("empty_headers"),
            F.col("sheet").isNull().alias("broken"),
        )
        good = good.unionByName(bad)
    return good.groupBy(file).agg(
        F.sum("ok").alias("sheets_processed"),
        F.sum("bad").alias("sheets_with_errors"),
        F.sum("headers_found").alias("headers_found"),
        F.sum("empty_headers").alias("empty_headers"),
        F.max("broken").alias("has_error"),
    )


def scan_rollup(
    bounds: DataFrame, headers: DataFrame, rejects: DataFrame, keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """Statistics of all sheets, of all files and in total from one aggregate: level, keys, measures.

    The levels are the grouping sets of a rollup over (file, sheet). Distinct headers are counted exactly at every
    level; Spark counts them by (group, header), so the total is spread over tasks, and a
    header's many cells are combined before they are sent. ``rejects`` has (file, sheet); a null sheet stands for a file that
    could not be opened.
    """
    file, sheet = keys

    def facts(rows: DataFrame, **columns: Column) -> DataFrame:
        names = ("header", "files", "broken", "sheets", "errors", "empty", "cleaned")
        empty = {"header": F.lit(None).cast("string")}
        chosen = [columns.get(n, empty.get(n, F.lit(0))).alias(n) for n in names]
        return rows.select(F.col(file).alias("file"), columns.get("sheet", F.lit(None).cast("string")).alias("sheet"), *chosen)

    one = F.lit(1)
    failed = rejects.select(file, F.col(sheet).isNull().cast("int").alias("broken"))
    files = bounds.select(file, F.lit(0).alias("broken")).unionByName(failed).groupBy(file).agg(F.max("broken").alias("broken"))
    rows = facts(files, files=one, broken=F.col("broken"))
    rows = rows.unionByName(facts(bounds, sheet=F.col(sheet), sheets=one))
    rows = rows.unionByName(facts(rejects.filter(F.col(sheet).isNotNull()), sheet=F.col(sheet), errors=one))
    kind = F.col("class")
    rows = rows.unionByName(
        facts(
            headers,
            sheet=F.col(sheet),
            header=F.col("header"),
            empty=kind.isin(EMPTY, EMPTIED).cast("int"),
            cleaned=(kind == CLEANED).cast("int"),
        )
    )
    level = F.when(F.grouping("file") == 1, "total").when(F.grouping("sheet") == 1, "file").otherwise("sheet")
    found = rows.rollup("file", "sheet").agg(
        level.alias("level"),
        F.sum("files").alias("files_processed"),
        F.sum("broken").alias("files_with_errors"),
        F.sum("sheets").alias("sheets_processed"),
        F.sum("errors").alias("sheets_with_errors"),
        F.count("header").alias("headers_found"),
        F.sum("empty").alias("empty_headers"),
        F.sum("cleaned").alias("cleaned_headers"),
        F.countDistinct("header").alias("unique_headers"),
    )
    # What is known of a file only is no sheet; without any input there is a total all the same.
    found = found.filter((F.col("level") != "sheet") | F.col("sheet").isNotNull())
    measures = found.columns[3:]
    return found.select("level", F.col("file").alias(file), F.col("sheet").alias(sheet), *[F.coalesce(m, F.lit(0)).alias(m) for m in measures])


def total_scan_stats(file_stats: DataFrame, provenance: DataFrame) -> DataFrame:
    """One row over all files; every file counts as processed, the unreadable ones too.

    ``headers_cleaned`` counts distinct headers that some text was changed into.
    """
    zero = F.lit(0).cast("bigint")
    files = file_stats.select(
        F.lit(1).cast("bigint").alias("files_processed"),
        F.col("has_error").cast("bigint").alias("files_with_errors"),
        "sheets_processed",
        "sheets_with_errors",
        "headers_found",
        "empty_headers",
        zero.alias("headers_cleaned"),
        zero.alias("unique_headers"),
    )
    distinct = provenance.select(
        *[zero.alias(c) for c in files.columns[:-2]],
        F.col("first_original").isNotNull().cast("bigint").alias("headers_cleaned"),
        F.lit(1).cast("bigint").alias("unique_headers"),
    )
    both = files.unionByName(distinct)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in both.columns])


def input_headers(headers: DataFrame, keys: Sequence[str] = SHEET_KEYS, tasks: int | None = None) -> DataFrame:
    """Usable headers of every sheet: keys, header, first_col, value_col.

    Cells holding zero or false name no column. A repeated header keeps its
    first place in the order, and its last column gives the values. The rows are
    placed by sheet, so all steps up to the plan of a sheet share one shuffle; a
    sheet has 16,384 headers at most. ``tasks`` is their number, if the session's does not do for very many sheets.
    """
    named = headers.filter(F.col("header").isNotNull() & ~_names_nothing())
    named = named.repartition(tasks, *keys) if tasks else named.repartition(*keys)
    return named.groupBy(*keys, "header").agg(
        F.min("col").alias("first_col"), F.max("col").alias("value_col")
    )


def target_layout(template_headers: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Target columns of a template sheet: trimmed texts (not cleaned), "" where there is none.

    Gives target, target_col for every column of the template's header row, after
    the keys if several templates are read at once.
    """
    text = F.coalesce(trim_space(F.col("text")), F.lit(""))
    return template_headers.select(
        *keys, F.when(_names_nothing(), "").otherwise(text).alias("target"), F.col("col").alias("target_col")
    )


def _names_nothing() -> Column:
    """True for a header cell that holds the number zero or false."""
    zero = (F.col("dtype") == "n") & (F.col("text").try_cast("double") == 0)
    false = (F.col("dtype") == "b") & (F.lower("text") == "false")
    return F.coalesce(zero | false, F.lit(False))
