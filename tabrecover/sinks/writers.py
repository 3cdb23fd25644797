"""Writers. All of them write from the executors, none through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrecover.grid import SHEET_KEYS, by_name
from tabrecover.plans.blocks import ROW_BLOCK, block_of
from tabrecover.plans.checkpoints import tasks_for_files
from tabrecover.plans.joins import lookup_join
from tabrecover.sources.lists import MAPPING_HEAD, MAPPING_TAIL

# Cell texts hold line breaks, quotes and outer spaces; all of them are kept.
CSV_OPTIONS = {
    "header": True,
    "multiLine": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
#: Most tasks that list the folders below a path.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def land_grid(
    decoded: DataFrame,
    path: str,
    table: str | None = None,
    buckets: int = 0,
    keys: Sequence[str] = SHEET_KEYS,
) -> DataFrame:
    """Store decoded workbooks, or any grid, once and give back the stored rows.

    With a table name the rows are stored in buckets by sheet and row block, so
    that the joins with bounds and plans leave the grid where it is. A bucket
    never holds more of one sheet than a block of rows.
    """
    placed = decoded.withColumn("block", block_of(F.col("row")))
    if table is None:
        placed.write.parquet(path)
        return decoded.sparkSession.read.schema(placed.schema).parquet(path)
    at = [*keys, "block"]
    # one writer per bucket, or every task would leave a file in every bucket
    rows = placed.repartition(buckets, *at)
    rows.write.bucketBy(buckets, *at).sortBy(*at).option("path", path).format("parquet").saveAsTable(table)
    return decoded.sparkSession.table(table)


def write_lines(lines: DataFrame, path: str, text: str = "header", order: Sequence[str] = ()) -> None:
    """One line per row, sorted; the part files in name order are the whole list."""
    ordered = lines.orderBy(*(order or [text]))
    ordered.select(F.col(text).alias("value")).write.text(path)


def write_mapping(entries: DataFrame, path: str) -> None:
    """One mapping document of any size, one entry per line, sorted by header.

    ``entries`` has scanned, target, is_ignored with one row per header. The part
    files, put together in name order, are the document, and no task holds more
    than its own lines. ``read_mapping`` reads the folder as it is.
    """
    entry = F.to_json(
        F.struct(
            F.coalesce("scanned", F.lit("")).alias("scanned_column"),
            F.coalesce("target", F.lit("")).alias("target_column"),
            F.coalesce("is_ignored", F.lit(False)).alias("is_ignored"),
        )
    )
    spark = entries.sparkSession
    body = entries.select(F.lit(1).alias("part"), F.coalesce("scanned", F.lit("")).alias("scanned"), entry.alias("value"))
    ends = spark.createDataFrame([(0, "", MAPPING_HEAD), (2, "", MAPPING_TAIL)], "part int, scanned string, value string")
    first = body.agg(F.min("scanned").alias("first")).first()["first"]
    comma = F.when(F.col("scanned") == F.lit(first), "").otherwise(",")
    lines = body.select("part", "scanned", F.concat(comma, "value").alias("value"))
    lines.unionByName(ends).orderBy("part", "scanned").select("value").write.text(path)


def write_sheets(
    formatted: DataFrame,
    path: str,
    fmt: str = "parquet",
    keys: Sequence[str] = SHEET_KEYS,
    folder_per_sheet: bool = True,
    row_block: int = ROW_BLOCK,
) -> None:
    """Formatted rows as parquet, csv or json, one folder per sheet.

    A row block of a sheet is one sorted file. A file costs a task some ten milliseconds however few rows
    it has, so the tasks are never put together by their bytes. ``folder_per_sheet=False`` writes
    one table with the sheet as columns, for very many small sheets.
    """
    keys = list(keys)
    order = [*keys, "target_row"]
    block = block_of(F.col("target_row"), row_block)
    if folder_per_sheet:
        placed = formatted.repartition(tasks_for_files(formatted.sparkSession), *by_name(keys), block).sortWithinPartitions(*order)
        writer = placed.write.partitionBy(*keys)
    else:
        writer = formatted.write
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(fmt).save(path)


def write_named_sheets(
    formatted: DataFrame, names: DataFrame, path: str, fmt: str = "parquet", keys: Sequence[str] = SHEET_KEYS, row_block: int = ROW_BLOCK
) -> None:
    """Formatted rows, one folder ``output=<name>`` per sheet; the keys stay columns.

    ``names`` has the keys and the output name of each sheet, no name twice (``reports.unique_names``).
    Where a target is called output too, the folders' column gets underscores behind it.
    """
    keys = list(keys)
    column = "output"
    while column in {c.lower() for c in formatted.columns}:
        column += "_"
    name = names.select(*by_name(keys), F.col("output").alias(column))
    named = lookup_join(formatted, name, keys)
    block = block_of(F.col("target_row"), row_block)
    placed = named.repartition(tasks_for_files(named.sparkSession), column, block).sortWithinPartitions(column, "target_row")
    writer = placed.write.partitionBy(column)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    writer.format(fmt).save(path)


def read_sheets(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Read back what ``write_sheets`` wrote; the keys stay text.

    The folders of a file's sheets are listed by as many tasks as write them, and not by one each, as
    Spark does below 10,000: the start of such a task takes longer than its folder.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    before = spark.conf.get(LISTING_TASKS, None)
    spark.conf.set(LISTING_TASKS, str(tasks_for_files(spark)))
    try:
        rows = reader.format(fmt).load(path)
    finally:
        if before is None:
            spark.conf.unset(LISTING_TASKS)
        else:
            spark.conf.set(LISTING_TASKS, before)
    return rows.select(*by_name(schema.names))


def write_report(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """A report such as the unmapped headers, in its own folder."""
    writer = report.write.options(**CSV_OPTIONS) if fmt == "csv" else report.write
    writer.format(fmt).save(path)


def append_stats(stats: DataFrame, path: str, run: str) -> None:
    """Add statistics or audit rows of one run to a parquet table with a folder per run.

    A run that is repeated under its name, after a failure say, replaces its own rows; those of
    other runs stay.
    """
    writer = stats.withColumn("run", F.lit(run)).write.partitionBy("run").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)
