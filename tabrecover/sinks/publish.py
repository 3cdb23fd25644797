"""Outputs of a job that count all at once, and a run after a failure that replaces its own.

    path/attempts/run=R/attempt=A/<output>   what one attempt of a run has written
    path/manifests/run=R/version=N           one row, written last: the attempt that counts

A job writes below a folder that no other attempt uses. Only when it has ended is its folder named in
a manifest, so readers see all outputs of a run or none of them, and while a run is repeated they go on seeing those
of the time before. Nothing is changed in place: an attempt that failed leaves a
folder that no manifest names. Runs of different names do not touch each other; one run is published
by one job at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tabrecover.grid import by_name
from tabrecover.sinks.writers import CSV_OPTIONS

_MANIFEST = "attempt string, run string, version bigint"


def _attempt_folder(path: str, run: str, attempt: str) -> str:
    return f"{path}/attempts/run={run}/attempt={attempt}"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The published runs: run, attempt, version (how often the run has been published)."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "run string, attempt string, version bigint")
    return rows.groupBy("run").agg(F.max_by("attempt", "version").alias("attempt"), F.max("version").alias("version"))


def publish(spark: SparkSession, path: str, run: str, job: Callable[[str], object]) -> str:
    """Let a job write below a fresh folder and publish it as the run's outputs; gives the folder.

    ``job`` gets the folder. If it raises, nothing changes for readers. Names of runs are
    letters, digits, ``-``, ``_`` and ``.``, since they are part of a path.
    """
    if not run or not all(c.isascii() and (c.isalnum() or c in "-_.") for c in run):
        raise ValueError(f"not a name of a run: {run!r}")
    attempt = uuid.uuid4().hex
    folder = _attempt_folder(path, run, attempt)
    job(folder)
    known = manifest(spark, path).filter(F.col("run") == run).first()
    version = known["version"] + 1 if known else 1
    one = spark.createDataFrame([(attempt,)], "attempt string").coalesce(1)
    one.write.mode("errorifexists").parquet(f"{path}/manifests/run={run}/version={version}")
    return folder


def published_folder(spark: SparkSession, path: str, run: str) -> str | None:
    """The folder with the outputs of a run that count, if it has been published."""
    found = manifest(spark, path).filter(F.col("run") == run).first()
    return _attempt_folder(path, run, found["attempt"]) if found else None


def published(spark: SparkSession, path: str, output: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """Rows of an output in all published runs, with the column run.

    For outputs that are no partitioned table themselves. One folder per run is named to the reader.
    """
    columns = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    with_run = StructType([*columns.fields, StructField("run", StringType())])
    runs = manifest(spark, path).collect()
    if not runs:
        return spark.createDataFrame([], with_run)
    reader = spark.read.schema(StructType([*with_run.fields, StructField("attempt", StringType())]))
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    folders = [f"{_attempt_folder(path, r['run'], r['attempt'])}/{output}" for r in runs]
    rows = reader.format(fmt).option("basePath", f"{path}/attempts").load(folders)
    return rows.select(*by_name(with_run.names))
