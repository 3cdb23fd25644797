"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``RING`` places. Every shard owns some of them (its virtual nodes),
every key falls on one by its hash. Going round clockwise, a node takes the keys
that wait at its place until its shard is full; the rest go on to the next node,
so after two rounds every key has a shard and no shard holds more than its bound.
With ``load_factor`` 1 the bounds add up to the number of rows, and shards differ
by one row at most; a larger factor moves fewer keys when shards are added.

Only the number of rows at each place goes to the driver, at most ``RING``
numbers, and the plan that comes back has a bounded number of rows too. Rows are
numbered within a place; a place with more than ``CROWD`` rows (one id may have a third of all) is numbered in
parts, one for each ``CROWD`` of them, whose counts say where each part begins. So no step gathers
more than about rows / RING or ``CROWD`` rows.

Defined results: rows with a null id are placed by their size and checksum, a
null text has no bytes and checksum 0, repeated rows take places one after the
other, an empty table gives no rows, other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from math import ceil

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabrecover.llm.common import stored

#: Places on the ring.
RING = 1 << 16
#: Virtual nodes of a shard.
NODES = 128
#: Rows of a place that are numbered in one task.
CROWD = 1 << 20
#: Bytes that a row takes beside its text.
ROW_OVERHEAD = 16


def ring_nodes(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise. Adding a shard leaves those of the others where they are."""
    found = [
        (xxhash.xxh3_64_intdigest(f"{shard}/{i}") % RING, xxhash.xxh3_64_intdigest(f"{i}:{shard}"), shard)
        for shard in range(shards)
        for i in range(nodes)
    ]
    return [(place, shard) for place, _, shard in sorted(found)]


def bounds(rows: int, shards: int, load_factor: float) -> list[int]:
    """Most rows of each shard."""
    if load_factor <= 1:
        return [rows // shards + (s < rows % shards) for s in range(shards)]
    return [ceil(load_factor * rows / shards)] * shards


def place_keys(
    counts: dict[int, int], shards: int, load_factor: float = 1.0, nodes: int = NODES
) -> list[tuple[int, int, int, int, int]]:
    """Plan rows (place, first, end, shard, slot): rows first..end-1 of a place go to the shard, from that slot on."""
    ring = ring_nodes(shards, nodes)
    at = [place for place, _ in ring]
    room = bounds(sum(counts.values()), shards, load_factor)
    filled = [0] * shards
    # Keys wait at the first node at or after their place; behind the last node comes the first.
    arrive: list[list[list[int]]] = [[] for _ in ring]
    for place in sorted(counts):
        arrive[bisect_left(at, place) % len(ring)].append([place, 0, counts[place]])
    plan = []
    waiting: list[list[int]] = []
    for turn in range(2):
        for node, (_, shard) in enumerate(ring):
            if turn == 0:
                waiting += arrive[node]
            free, taken = room[shard] - filled[shard], 0
            while free and taken < len(waiting):
                place, first, end = waiting[taken]
                some = min(free, end - first)
                plan.append((place, first, first + some, shard, filled[shard]))
                filled[shard] += some
                free -= some
                if first + some == end:
                    taken += 1
                else:
                    waiting[taken][1] += some
            del waiting[:taken]
    return plan


def ring_shards(
    docs: DataFrame,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    load_factor: float = 1.0,
    nodes: int = NODES,
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; slots of a shard have no gaps."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("size", "text_crc32")).otherwise(F.xxhash64("doc_id"))
    rows = rows.withColumn("key", key).withColumn("place", F.pmod(F.col("key"), F.lit(RING)).cast("int"))
    # Equal rows are told apart by where they were read; the number is written down before it is used.
    spread = F.xxhash64("size", "text_crc32", F.monotonically_increasing_id())
    rows = stored(rows.withColumn("spread", spread))
    counts = {r["place"]: r["n"] for r in rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = docs.sparkSession.createDataFrame(
        place_keys(counts, shards, load_factor, nodes), "place int, first long, end long, shard int, start long"
    )
    ranked = _ranked(rows, {p: -(-n // CROWD) for p, n in counts.items() if n > CROWD}).alias("r")
    # The plan has at most RING + 2 * shards * nodes rows.
    return ranked.join(
        F.broadcast(plan.alias("p")),
        (F.col("r.place") == F.col("p.place")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")),
    ).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - F.col("first")).alias("slot"))


def _ranked(rows: DataFrame, parts: dict[int, int]) -> DataFrame:
    """Add the row's number within its place as ``rank``; ``parts`` says into how many parts a hot place is cut."""
    if not parts:
        rows = rows.withColumn("part", F.lit(0)).withColumn("before", F.lit(0))
    else:
        spark = rows.sparkSession
        hot = F.broadcast(spark.createDataFrame(list(parts.items()), "place int, parts int"))
        rows = rows.join(hot, "place", "left")
        rows = rows.withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("spread", "parts")).cast("int")).drop("parts")
        # One count per part, at most one part for each CROWD rows.
        found = rows.join(hot, "place", "left_semi").groupBy("place", "part").agg(F.count(F.lit(1)).alias("n")).collect()
        starts, at = [], {}
        for place, part, n in sorted(tuple(r) for r in found):
            starts.append((place, part, at.get(place, 0)))
            at[place] = at.get(place, 0) + n
        rows = rows.join(F.broadcast(spark.createDataFrame(starts, "place int, part int, before long")), ["place", "part"], "left")
        rows = rows.withColumn("before", F.coalesce("before", F.lit(0)))
    order = Window.partitionBy("place", "part").orderBy("key", "doc_id", "size", "text_crc32")
    return rows.withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
