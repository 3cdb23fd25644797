"""Review decisions as an ordered log, folded to one state per header.

Log rows: scanned, seq, action ("map" or "toggle_ignore"), target. The order is
given by seq, never by arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrecover.operators.mapping import IGNORED, MAPPED
from tabrecover.plans.joins import salted_join

MAP, TOGGLE_IGNORE = "map", "toggle_ignore"
UNDECIDED = "undecided"


def fold_decisions(log: DataFrame) -> DataFrame:
    """State per header: mapped, ignored or undecided, with the target if mapped.

    A map sets the target and clears an ignore; a toggle turns an ignored header
    into an undecided one and any other into an ignored one. So only the last
    map counts, and after it the number of toggles. Both are plain aggregates
    with map-side combine; a header with a third of the log stays spread out.
    """
    is_map = F.col("action") == MAP
    last = log.groupBy("scanned").agg(
        F.max(F.when(is_map, F.col("seq"))).alias("map_seq"),
        F.max_by("target", F.when(is_map, F.col("seq"))).alias("map_target"),
        F.count_if(F.col("action") == TOGGLE_IGNORE).alias("all_toggles"),
    )
    toggles = log.filter(F.col("action") == TOGGLE_IGNORE).select("scanned", "seq")
    maps = last.filter("map_seq is not null").select("scanned", "map_seq")
    counts = last.select("scanned", F.col("all_toggles").alias("n"))
    later = (
        salted_join(toggles, maps, ["scanned"], counts=counts)
        .filter("seq > map_seq")
        .groupBy("scanned")
        .agg(F.count(F.lit(1)).alias("later_toggles"))
    )
    flips = F.when(F.col("map_seq").isNull(), F.col("all_toggles")).otherwise(
        F.coalesce("later_toggles", F.lit(0))
    )
    state = (
        F.when(F.col("map_seq").isNotNull() & (flips == 0), MAPPED)
        .when(flips % 2 == 1, IGNORED)
        .otherwise(UNDECIDED)
    )
    folded = last.join(later, "scanned", "left").withColumn("state", state)
    return folded.select(
        "scanned", F.when(F.col("state") == MAPPED, F.col("map_target")).alias("target"), "state"
    )


def mapping_as_log(normalized: DataFrame) -> DataFrame:
    """A stored mapping as log rows which come before all others (seq -1)."""
    return normalized.select(
        "scanned",
        F.lit(-1).cast("bigint").alias("seq"),
        F.when(F.col("is_ignored"), TOGGLE_IGNORE).otherwise(MAP).alias("action"),
        "target",
    )


def saved_mapping(states: DataFrame) -> DataFrame:
    """Entries to store: mapped and ignored headers, sorted; suggestions are not stored."""
    return (
        states.filter(F.col("state").isin(MAPPED, IGNORED))
        .select(
            "scanned",
            F.when(F.col("state") == MAPPED, F.col("target")).otherwise("").alias("target"),
            (F.col("state") == IGNORED).alias("is_ignored"),
        )
        .orderBy("scanned")
    )


def review_worklist(undecided: DataFrame, cursor: int = 0) -> DataFrame:
    """Undecided lines (pos, header) in review order: after the cursor, then from the start.

    The line at the cursor itself is left out. Adds wrapped, and sorts.
    """
    return (
        undecided.filter(F.col("pos") != cursor)
        .withColumn("wrapped", F.col("pos") < cursor)
        .orderBy("wrapped", "pos")
    )
