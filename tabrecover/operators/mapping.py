"""The mapping from scanned headers to target columns.

A stored mapping has columns ord, scanned, target, is_ignored, and doc if it has
several documents. Its normal form has one row per header: scanned, target (null
if ignored), is_ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrecover.functions.text import trim_space
from tabrecover.plans.joins import lookup_join

MAPPED, IGNORED, SUGGESTED = "mapped", "ignored", "suggested"


def normalize_mapping(mapping: DataFrame) -> DataFrame:
    """One row per decided header: the last target wins, an ignore beats any target.

    The last one is that of the last document, and the largest name of those in
    one place. Entries which neither ignore nor name a target are dropped.
    """
    ignored = F.coalesce(F.col("is_ignored"), F.lit(False))
    named = ~ignored & (F.coalesce("target", F.lit("")) != "")
    place = [c for c in ("doc", "ord") if c in mapping.columns]
    per_header = mapping.groupBy("scanned").agg(
        F.max(ignored).alias("is_ignored"),
        F.max_by("target", F.when(named, F.struct(*place, "target"))).alias("target"),
    )
    return per_header.filter("is_ignored or target is not null").select(
        "scanned", F.when(~F.col("is_ignored"), F.col("target")).alias("target"), "is_ignored"
    )


def decided_headers(normalized: DataFrame) -> DataFrame:
    """Headers with a decision, mapped or ignored."""
    return normalized.select(F.col("scanned").alias("header"))


def auto_map_exact(scanned: DataFrame, normalized: DataFrame, targets: DataFrame) -> DataFrame:
    """Undecided headers equal to a target name map to it: scanned, target.

    Copies of a header are merged first, so no join key is hot afterwards.
    """
    names = targets.select(F.col("target").alias("header")).distinct()
    matched = (
        scanned.select("header")
        .distinct()
        .join(decided_headers(normalized), "header", "left_anti")
        .join(names, "header", "left_semi")
    )
    return matched.select(F.col("header").alias("scanned"), F.col("header").alias("target"))


def merge_mapping(stored: DataFrame, auto_mapped: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Session state per header: stored decisions, then exact matches, then suggestions.

    Gives scanned, target, state (mapped, ignored or suggested).
    """
    text = F.lit(None).cast("string")
    ranked = (
        stored.select(
            "scanned",
            F.lit(0).alias("rank"),
            F.when(F.col("is_ignored"), IGNORED).otherwise(MAPPED).alias("state"),
            F.when(F.col("is_ignored"), text).otherwise(F.col("target")).alias("target"),
        )
        .unionByName(
            auto_mapped.select("scanned", F.lit(1).alias("rank"), F.lit(MAPPED).alias("state"), "target")
        )
        .unionByName(
            suggestions.select("scanned", F.lit(2).alias("rank"), F.lit(SUGGESTED).alias("state"), "target")
        )
    )
    best = ranked.groupBy("scanned").agg(F.min(F.struct("rank", "state", "target")).alias("best"))
    return best.select("scanned", "best.target", "best.state")


def unmapped_headers(scanned: DataFrame, mapping: DataFrame) -> DataFrame:
    """Scanned lines (pos, header) without any entry in the mapping; order and copies kept."""
    known = mapping.select(F.col("scanned").alias("header")).distinct()
    return lookup_join(scanned, known, ["header"], "left_anti")


def unmapped_counts(scanned: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: total lines, distinct headers in the mapping, unmapped lines."""
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    total = scanned.select(one.alias("total"), zero.alias("decided"), zero.alias("unmapped"))
    known = mapping.select("scanned").distinct()
    decided = known.select(zero.alias("total"), one.alias("decided"), zero.alias("unmapped"))
    open_lines = unmapped_headers(scanned, mapping)
    still_open = open_lines.select(zero.alias("total"), zero.alias("decided"), one.alias("unmapped"))
    parts = total.unionByName(decided).unionByName(still_open)
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns])


def mapping_coverage(scanned: DataFrame, session: DataFrame) -> DataFrame:
    """One row: total lines, mapped, suggested, ignored, and what is left of the total."""
    flag = F.lit(None).cast("string")
    lines = scanned.select(F.lit(1).alias("line"), flag.alias("state"))
    states = session.select(F.lit(0).alias("line"), "state")
    counted = lines.unionByName(states).agg(
        F.count_if(F.col("line") == 1).alias("total"),
        F.count_if(F.col("state") == MAPPED).alias("mapped"),
        F.count_if(F.col("state") == SUGGESTED).alias("suggested"),
        F.count_if(F.col("state") == IGNORED).alias("ignored"),
    )
    left = F.col("total") - F.col("mapped") - F.col("ignored") - F.col("suggested")
    return counted.withColumn("unmapped", left)


def mapping_fan_in(normalized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: how many headers lead to it (0 for none), and the first and last of them.

    The headers themselves are the mapping's rows; a target may have any number
    of them, so they are counted and not collected.
    """
    edges = normalized.filter("target is not null").groupBy("target")
    counts = edges.agg(
        F.count(F.lit(1)).alias("headers"),
        F.min("scanned").alias("first_header"),
        F.max("scanned").alias("last_header"),
    )
    names = targets.select("target").distinct()
    return names.join(counts, "target", "left").fillna(0, ["headers"])


def append_targets(existing: DataFrame, template_headers: DataFrame) -> DataFrame:
    """Target list with the template's new headers after the old entries.

    ``existing`` has pos, target and keeps its copies; ``template_headers`` has
    col, text. Gives part (0 old, 1 new), pos, target; the order is (part, pos).
    """
    old = existing.select(F.lit(0).alias("part"), F.col("pos").cast("bigint").alias("pos"), "target")
    name = F.coalesce(trim_space(F.col("text")), F.lit(""))
    new = (
        template_headers.select(name.alias("target"), F.col("col").cast("bigint").alias("pos"))
        .filter("target <> ''")
        .groupBy("target")
        .agg(F.min("pos").alias("pos"))
        .join(existing.select(trim_space(F.col("target")).alias("target")).distinct(), "target", "left_anti")
    )
    return old.unionByName(new.select(F.lit(1).alias("part"), "pos", "target"))
