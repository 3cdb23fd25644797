"""A stored grid whose files can be replaced: ledger, versions, and facts of every sheet.

    path/commits/version=N   one row, written last: the version counts from then on, all at once
    path/ledger/version=N    files that came, changed or went: file, length, modified, added
    path/rows/version=N      their decoded rows
    path/bounds/version=N, path/headers/version=N   bounds and cleaned headers of their sheets

A run lists the folders, compares the listing with the ledger and decodes only files that are
new or whose length or time differs. Nothing is changed in place: rows of an older version of
a file stay where they are and are left out when the grid is read, by an anti-join with
the list of replaced files, which is as long as the changes are. A run that fails before its commit
leaves a version nobody reads, and the next run writes over it; of two runs at a
time the second one's commit fails. ``compact`` writes the live rows as one version.

Bounds and headers are kept per version too. Statistics and provenance are sums and minima over these few rows
of the live files, so a file that comes adds its own, one that goes takes its own away, and no cell is
read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabrecover.grid import GRID_SCHEMA
from tabrecover.operators import bounds as B
from tabrecover.operators import headers as H
from tabrecover.plans.blocks import blocked
from tabrecover.plans.checkpoints import stored
from tabrecover.plans.joins import lookup_join
from tabrecover.sources.files import list_files
from tabrecover.sources.workbook import decode_workbooks, grid_of, rejects_of

LEDGER = "file string, length bigint, modified bigint, added boolean"
SCHEMAS = {
    "rows": f"{GRID_SCHEMA}, error string, block bigint",
    "bounds": "file string, sheet string, sheet_idx bigint, max_row bigint, max_col int, header_row bigint",
    "headers": "file string, sheet string, sheet_idx bigint, row bigint, col int, text string, dtype string, raw string, header string, class string",
}


def _commits(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """Committed versions with the first version that each still needs; one row per run."""
    try:
        found = spark.read.schema("base bigint, version bigint").parquet(f"{path}/commits")
        return sorted((r["version"], r["base"]) for r in found.collect())
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def _versions(spark: SparkSession, path: str) -> list[int]:
    commits = _commits(spark, path)
    return [v for v, _ in commits if v >= commits[-1][1]]


def _part(spark: SparkSession, path: str, part: str, schema: str, versions: Sequence[int]) -> DataFrame:
    """A part's rows of the versions, with the column version."""
    if not versions:
        return spark.createDataFrame([], f"{schema}, version bigint")
    folders = [f"{path}/{part}/version={v}" for v in versions]
    return spark.read.schema(f"{schema}, version bigint").option("basePath", f"{path}/{part}").parquet(*folders)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The live files: file, length, modified, version."""
    entries = _part(spark, path, "ledger", LEDGER, _versions(spark, path))
    last = entries.groupBy("file").agg(F.max_by(F.struct("length", "modified", "added", "version"), "version").alias("last"))
    return last.filter("last.added").select("file", "last.length", "last.modified", "last.version")


def current(spark: SparkSession, path: str, part: str = "rows") -> DataFrame:
    """Rows, bounds or headers of the live files, each from its last version."""
    versions = _versions(spark, path)
    rows = _part(spark, path, part, SCHEMAS[part], versions)
    if len(versions) > 1:
        entries = _part(spark, path, "ledger", LEDGER, versions)
        last = entries.groupBy("file").agg(F.max("version").alias("last"))
        replaced = entries.filter("added").join(last, "file").filter("version < last").select("file", "version")
        rows = lookup_join(rows, stored(replaced), ["file", "version"], "left_anti")
    return rows.drop("version")


def _commit(spark: SparkSession, path: str, version: int, base: int) -> None:
    one = spark.createDataFrame([(base,)], "base bigint").coalesce(1)
    one.write.mode("errorifexists").parquet(f"{path}/commits/version={version}")


def _write(rows: DataFrame, path: str, part: str, version: int) -> DataFrame:
    """Write a part of a version, in place of what a failed run may have left there."""
    place = f"{path}/{part}/version={version}"
    schema = StructType.fromDDL(SCHEMAS.get(part, LEDGER))
    rows.select(*schema.names).write.mode("overwrite").parquet(place)
    return rows.sparkSession.read.schema(schema).parquet(place)


def ingest_changed(spark: SparkSession, roots: Sequence[str], path: str, partitions: int | None = None) -> int | None:
    """Bring a store up to date with the folders; gives the new version, or none if nothing has changed.

    A file is known by its path; it is read again if its length or its time of change differs, and
    its rows go if the folders do not hold it any more. ``current`` reads the result.
    """
    commits = _commits(spark, path)
    version, base = (commits[-1][0] + 1, commits[-1][1]) if commits else (1, 1)
    found = stored(list_files(spark, roots).select("file", "length", "modified"))
    known = ledger(spark, path).select("file", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"), F.lit(True).alias("known"))
    both = stored(found.withColumn("found", F.lit(True)).join(known, "file", "full_outer"))
    same = F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified"))
    new = both.filter(F.col("found") & ~(F.coalesce("known", F.lit(False)) & same))
    gone = both.filter(F.col("found").isNull())
    changes = new.select("file", "length", "modified", F.lit(True).alias("added")).unionByName(
        gone.select("file", F.col("old_length").alias("length"), F.col("old_modified").alias("modified"), F.lit(False).alias("added"))
    )
    changes = stored(changes)
    if commits and changes.isEmpty():
        return None
    decoded = decode_workbooks(changes.filter("added").select("file"), partitions=partitions)
    rows = _write(blocked(decoded), path, "rows", version)
    bounds = _write(B.sheet_bounds(grid_of(rows)), path, "bounds", version)
    _write(H.clean_headers(H.sheet_headers(grid_of(rows), bounds)), path, "headers", version)
    _write(changes, path, "ledger", version)
    _commit(spark, path, version, base)
    return version


def compact(spark: SparkSession, path: str) -> int:
    """Write what is live as one version; older versions are not read any more. Gives the version."""
    version = _commits(spark, path)[-1][0] + 1
    for part in SCHEMAS:
        _write(current(spark, path, part), path, part, version)
    _write(ledger(spark, path).withColumn("added", F.lit(True)), path, "ledger", version)
    _commit(spark, path, version, version)
    return version


def scan_stats(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statistics per sheet and file, and the provenance of headers, from the kept bounds and headers."""
    bounds, headers = stored(current(spark, path, "bounds")), stored(current(spark, path, "headers"))
    sheets = H.sheet_scan_stats(bounds, headers)
    rejects = rejects_of(current(spark, path, "rows"))
    return sheets, H.file_scan_stats(sheets, rejects), H.header_provenance(headers)
