"""From raw documents to token ids, stage by stage.

Every stage takes the documents its predecessor kept, whole, and its decision
takes effect: toxic documents go, one document of each group of near copies
stays, passages that repeat are cut out of later documents, documents that leak
benchmark items go, and what is left is encoded. All stages but the last return
the columns of ``documents``; texts that lose a passage get a new ``n_chars``.

Rows are judged one by one, by their texts: repeated ids and rows without an id are
handled like any other. Of a group of near copies the row with the smallest id stays, a row
whose id occurs once before one whose id is repeated or missing. Rows without words are no copies.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrecover.llm import bpe, decontaminate, minhash_forest, substring_dedup, toxicity
from tabrecover.llm.common import bounded_batches, stored, table
from tabrecover.plans.joins import lookup_join

VOCAB = os.environ.get("LLM_VOCAB", public_tokenizers.path("byte_bpe_50k.json"))
#: Similarity in percent from which two documents are near copies.
SIMILAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    key = "row"
    while key in docs.columns:
        key += "_"
    rows = _numbered(docs, key)
    found = minhash_forest.near_duplicates(rows, id_col=key, percent=SIMILAR)
    gone = stored(found.filter(~F.col("kept")).select(F.col("doc_id").alias(key)))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def _numbered(docs: DataFrame, key: str) -> DataFrame:
    """The rows with a number of their own: the id where it occurs once, else one above all ids."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(ids.filter((F.col("n") > 1) | F.col("doc_id").isNull()).select("doc_id"))
    if repeated.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    top = docs.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0)).alias("top")).first()["top"]
    once = lookup_join(docs.filter(F.col("doc_id").isNotNull()), repeated, ["doc_id"], "left_anti")
    others = lookup_join(docs.filter(F.col("doc_id").isNotNull()), repeated, ["doc_id"], "left_semi")
    others = others.unionByName(docs.filter(F.col("doc_id").isNull()))
    # The numbers are written down, so that they stay the same from here on.
    others = others.withColumn(key, F.monotonically_increasing_id() + F.lit(top + 1))
    return stored(once.withColumn(key, F.col("doc_id").cast("long")).unionByName(others))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = substring_dedup.remove_repeats(docs, carry=others)
    cut = F.col("n_removed") > 0
    columns = [
        F.when(cut, F.length("kept").cast(docs.schema[c].dataType)).otherwise(F.col("rest")[c]).alias(c)
        if c == "n_chars"
        else F.col("kept").alias("text")
        if c == "text"
        else F.col("doc_id").cast(docs.schema[c].dataType).alias("doc_id")
        if c == "doc_id"
        else F.col("rest")[c].alias(c)
        for c in docs.columns
    ]
    return found.select(columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return bpe.encode(docs, VOCAB, outputs="both")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe_encoding", encode),
]

#: Learned weights, similarity graphs and token ids are beyond SQL; every stage is tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
