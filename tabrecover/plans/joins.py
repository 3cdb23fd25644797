"""Joins of a large table to a lookup table, safe against hot keys.

One header text may make up a third of all header cells, so a plain equi-join
on the header would put a third of the data into one task. ``lookup_join``
broadcasts the lookup side when its measured size allows it and otherwise
cuts the hot keys of the large side into parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrecover.grid import by_name

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
HOT_ROWS = 1_000_000


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure a lookup table; reads ``max_rows + 1`` rows of it at most.

    Meant for tables which are cheap to read, such as a mapping or a target list.
    """
    size = F.octet_length(F.to_json(F.struct(*by_name(df.columns))))
    found = (
        df.limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("size"))
        .first()
    )
    return found["n"] <= max_rows and found["size"] <= max_bytes


def key_counts(large: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows per key: the key columns and n."""
    return large.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))


def salted_join(
    large: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join with the hot keys of the large side cut into parts.

    A key with more than ``HOT_ROWS`` rows gets one part per ``HOT_ROWS`` of
    them, and only its lookup rows are copied, once per part. All other keys
    are joined as they are. The list of hot keys is broadcast: it has at most
    one row per ``HOT_ROWS`` rows of the large side. Parts go by a hash of the
    other columns; every part has the
    same lookup rows, so it does not matter which one a row is in. Without other columns the rows of
    a key are all alike, and their number is joined in their place. ``counts`` (key,
    n) saves counting where the caller has done so. ``how`` is inner, left,
    left_semi or left_anti.
    """
    on = list(on)
    others = [c for c in large.columns if c not in on]
    counted = key_counts(large, on) if counts is None else counts
    if not others:
        pieces = F.transform(
            F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / HOT_ROWS)),
            lambda p: F.least(F.lit(HOT_ROWS).cast("long"), F.col("n") - p * HOT_ROWS),
        )
        dealt = key_counts(large, on).select(*by_name(on), F.explode(pieces).alias("_size"))
        found = dealt.join(lookup, on, how)
        return found.withColumn("_nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_size")))).drop("_size", "_nth")
    hot = counted.filter(F.col("n") > HOT_ROWS).select(
        *on, F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("_parts")
    )
    hot = F.broadcast(hot)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    part = F.when(parts == 1, 0).otherwise(F.pmod(F.xxhash64(*by_name(others)), parts))
    copies = F.explode(F.sequence(F.lit(0), parts - 1))
    left = large.join(hot, on, "left").withColumn("_part", part.cast("int")).drop("_parts")
    right = lookup.join(hot, on, "left").withColumn("_part", copies).drop("_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def lookup_join(
    large: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Broadcast join when the lookup is measured to be small, salted join otherwise."""
    if fits_broadcast(lookup):
        return large.join(F.broadcast(lookup), list(on), how)
    return salted_join(large, lookup, on, how)
