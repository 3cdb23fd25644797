"""Positions 0, 1, 2, ... of a sorted table, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabrecover.grid import by_name
from tabrecover.plans.checkpoints import settle

_WITHIN = (1 << 33) - 1


def with_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """Add the 0-based position in the order of the given columns.

    The rows are range-partitioned and sorted, and settled in the checkpoint
    folder together with their partition number and place in the partition.
    Only one count per partition is then summed up and broadcast, so its size
    is the number of partitions. Rows that the order leaves equal are told apart by
    their place in the input, so copies of one row are spread over partitions too; that place is
    settled first, or a task that runs again could deal its rows otherwise than before.
    The order must be total for a stable result.
    """
    tied = settle(df.withColumn("_tie", F.monotonically_increasing_id()))
    ranked = settle(tied.orderBy(*order, "_tie").withColumn("_id", F.monotonically_increasing_id()))
    ranked = ranked.select(
        *by_name(df.columns),
        F.shiftright("_id", 33).alias("_part"),
        F.col("_id").bitwiseAND(F.lit(_WITHIN)).alias("_place"),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranked.join(F.broadcast(starts), "_part").select(
        *by_name(df.columns), (F.col("_start") + F.col("_place")).alias(name)
    )
