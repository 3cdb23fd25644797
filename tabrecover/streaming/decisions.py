"""Mapping state kept up to date while review decisions come in.

Toggles count only after the last map of their header, so a batch cannot be
added to an old state by itself. Every batch is added to the stored log, and
the headers it touches are folded again from there. The order is given by seq,
so late decisions are harmless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tabrecover.operators.decisions import fold_decisions
from tabrecover.plans.joins import lookup_join

LOG_SCHEMA = "scanned string, seq bigint, action string, target string"
STATE_SCHEMA = "scanned string, target string, state string"


def follow_decisions(log: DataFrame, path: str) -> DataStreamWriter:
    """Writer that stores the log of a stream and the states after every batch.

    A batch that runs again replaces its own files, so each decision counts once.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={number}")
        touched = spark.read.schema(LOG_SCHEMA).parquet(f"{path}/log/batch={number}").select("scanned").distinct()
        whole = spark.read.schema(f"{LOG_SCHEMA}, batch bigint").parquet(f"{path}/log")
        again = lookup_join(whole.drop("batch"), touched, ["scanned"], "left_semi")
        fold_decisions(again).write.mode("overwrite").parquet(f"{path}/states/batch={number}")

    return log.select("scanned", "seq", "action", "target").writeStream.foreachBatch(add)


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of every header: scanned, target, state."""
    states = spark.read.schema(f"{STATE_SCHEMA}, batch bigint").parquet(f"{path}/states")
    latest = states.groupBy("scanned").agg(F.max_by(F.struct("target", "state"), "batch").alias("now"))
    return latest.select("scanned", "now.target", "now.state")
