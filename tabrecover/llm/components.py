"""Connected components with DataFrame operations only.

Alternates two star operations until nothing changes: every node links its
larger neighbours to the smallest node it sees, then its smaller ones and itself.
Edges end as stars around the smallest node of each component, after a number of
rounds that grows with the logarithm of the size. Every round is written to the
shared folder, which cuts the lineage. A hub is joined in parts (``salted_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrecover.llm.common import stored
from tabrecover.plans.joins import salted_join


def _with_least(pairs: DataFrame) -> DataFrame:
    """Add the smallest ``v`` of each ``u`` as ``least``."""
    found = pairs.groupBy("u").agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("n"))
    return salted_join(pairs, found.drop("n"), ["u"], counts=found.select("u", "n"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = _with_least(both).filter(F.col("v") > F.col("u"))
    return found.select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_least(edges)
    own = found.select("u", F.col("least").alias("v"))
    others = found.filter(F.col("v") != F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    return own.unionByName(others).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark")
    ).first()
    return row["n"], row["mark"]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``u, v``: the component is its smallest node.

    Rows with a null end are left out, loops keep their node, repeated edges count once.
    """
    edges = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    loops = edges.filter(F.col("u") == F.col("v")).select(F.col("u").alias("node")).distinct()
    links = edges.filter(F.col("u") != F.col("v"))
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links)
    state = _state(links)
    while state[0]:
        links = stored(_small_star(_large_star(links)))
        new = _state(links)
        if new == state:
            break
        state = new
    found = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    alone = loops.join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))
