"""Reliable checkpoints in the folder the cluster names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a grid that a task sorts: some hundred megabytes at most, with the copies of several steps.
TASK_ROWS = 100_000
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder set by ``spark.checkpoint.dir``.

    Only a session that names none and runs in one process (a local test run) gets
    a fresh folder, which is removed when the process ends.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tabrecover-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Write the rows once, so that later uses see the same rows in the same order."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, group_bytes: int | None = None) -> DataFrame:
    """Write the rows once as a parquet table in the checkpoint folder and read that instead.

    For a table several plans use: each then reads only the columns it needs. ``group_bytes`` is the size of its row groups;
    a reader takes some thousand rows of a group at a time, which is much for rows of many kilobytes.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        writer = df.write if group_bytes is None else df.write.option("parquet.block.size", group_bytes)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """As many tasks as keep ``TASK_ROWS`` rows each, and at least those of any shuffle.

    Rows of sheets compress tenfold, so a number of tasks by shuffled bytes, or a fixed one, gives each
    task more than it can sort without spilling once the input grows.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def tasks_for_files(spark: SparkSession) -> int:
    """Tasks for work that costs as much for a file of one row as for a larger one: four a core, and at least those of any shuffle."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def stored_in_buckets(df: DataFrame, at: Sequence[str], buckets: int, dealt: bool = False) -> DataFrame:
    """As ``stored``, in buckets by some columns: joins and aggregates by them leave the rows where they are.

    Rows that are ``dealt`` to as many tasks by these columns already are written where they are.
    """
    spark = df.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        rows = (df if dealt else df.repartition(buckets, *at)).write.bucketBy(buckets, *at).sortBy(*at)
        rows.option("path", f"{checkpoint_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the shuffle files of what runs in here once it has ended: the rows are stored, and nothing else reads those files."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
