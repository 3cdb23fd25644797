"""Reports on a formatting run: sheet summaries, rejects, output names, file status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrecover.functions.text import is_blank, is_formula, output_name
from tabrecover.grid import SHEET_KEYS, by_name
from tabrecover.operators.formatting import Layout
from tabrecover.plans.joins import salted_join

NO_HEADER = "no header"
NO_MAPPING = "no applicable mapping"

#: Bytes of an output name that is used as it is.
NAME_BYTES = 120


def format_summary(
    projected: DataFrame, plans: DataFrame, layout: Layout, keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """Per sheet: target columns processed, mapped and skipped, cells copied, formulas skipped,
    rows removed.

    ``projected`` comes from ``project_cells``. Rows removed are all rows below
    the header, up to the sheet's last row, that hold no data.
    """
    keys = list(keys)
    values = F.col("picked.value")
    formulas = F.size(F.filter(values, is_formula)).cast("bigint")
    copied = F.size(F.filter(values, lambda v: ~is_blank(v) & ~is_formula(v))).cast("bigint")
    counts = (
        projected.select(*keys, copied.alias("copied"), formulas.alias("formulas"))
        .groupBy(*keys)
        .agg(
            F.sum("copied").alias("cells_copied"),
            F.sum("formulas").alias("formulas_skipped"),
            F.count_if(F.col("copied") > 0).alias("rows_kept"),
        )
    )
    mapped = F.size(F.filter("input_cols", lambda c: c.isNotNull())).cast("bigint")
    rows = F.col("max_row") - F.col("header_row")
    joined = plans.select(
        *keys,
        F.lit(len(layout.columns)).cast("bigint").alias("columns_processed"),
        mapped.alias("columns_mapped"),
        (len(layout.columns) - mapped).alias("columns_skipped"),
        rows.alias("rows"),
    ).join(counts, keys, "left")
    filled = joined.fillna(0, ["cells_copied", "formulas_skipped", "rows_kept"])
    return filled.withColumn("rows_removed", F.col("rows") - F.col("rows_kept")).drop("rows", "rows_kept")


def sheet_rejects(
    sheet_stats: DataFrame, plans: DataFrame, keys: Sequence[str] = SHEET_KEYS
) -> DataFrame:
    """Sheets which give no output: keys, stage, reason."""
    keys = list(keys)
    headerless = sheet_stats.filter("headers_found = 0").select(
        *keys, F.lit("scan").alias("stage"), F.lit(NO_HEADER).alias("reason")
    )
    unmapped = (
        plans.filter(~F.exists("input_cols", lambda c: c.isNotNull()))
        .select(*keys)
        .join(headerless.select(*keys), keys, "left_anti")
        .select(*keys, F.lit("format").alias("stage"), F.lit(NO_MAPPING).alias("reason"))
    )
    return headerless.unionByName(unmapped)


def output_names(bounds: DataFrame, keys: Sequence[str] = SHEET_KEYS) -> DataFrame:
    """Per sheet the output name "<file stem>-<sheet>" and how many outputs share it.

    Very many folders may hold a workbook of the same name, so the names are
    joined as possibly hot keys.
    """
    file, sheet = keys
    named = bounds.select(*keys, output_name(F.col(file), F.col(sheet)).alias("output"))
    shared = named.groupBy("output").agg(F.count(F.lit(1)).alias("sheets"))
    counts = shared.withColumnRenamed("sheets", "n")
    return salted_join(named, shared.filter("sheets > 1"), ["output"], "left", counts).select(
        *keys, "output", F.coalesce("sheets", F.lit(1).cast("bigint")).alias("sheets")
    )


def unique_names(bounds: DataFrame, keys: Sequence[str] = SHEET_KEYS) -> DataFrame:
    """Per sheet an output name that no other sheet has.

    The name is "<file stem>-<sheet>". Sheets that would share it, in any case of letters since some storage
    does not tell them apart, get a hash of their keys behind it; so does a name too long for a file
    system, which is cut before it.
    """
    keys = list(keys)
    named = output_names(bounds, keys).drop("sheets").withColumn("_folded", F.lower("output"))
    counts = named.groupBy("_folded").agg(F.count(F.lit(1)).alias("n"))
    shared = counts.filter("n > 1").select("_folded", F.lit(True).alias("_shared"))
    marked = salted_join(named, shared, ["_folded"], "left", counts)
    mark = F.substring(F.sha2(F.to_json(F.array(*[k.cast("string") for k in by_name(keys)])), 256), 1, 32)
    long = F.octet_length("output") > NAME_BYTES
    stem = F.when(long, F.substring("output", 1, NAME_BYTES // 4)).otherwise(F.col("output"))
    name = F.when(F.col("_shared") | long, F.concat_ws("-", stem, mark)).otherwise(F.col("output"))
    return marked.select(*by_name(keys), name.alias("output"))


def batch_summary(
    sheets: DataFrame, rejects: DataFrame, file: str = "file"
) -> DataFrame:
    """Files by status: "error" if the file or any of its sheets was rejected, else "success".

    A sheet without a header, such as a blank one, is reported but is no error.
    """
    bad = (F.col("reason") != NO_HEADER).cast("int")
    status = sheets.select(file, F.lit(0).alias("bad")).unionByName(
        rejects.select(file, F.coalesce(bad, F.lit(1)).alias("bad"))
    )
    per_file = status.groupBy(file).agg(F.max("bad").alias("bad"))
    return per_file.groupBy(
        F.when(F.col("bad") == 1, "error").otherwise("success").alias("status")
    ).agg(F.count(F.lit(1)).alias("files"))
