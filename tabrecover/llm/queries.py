"""The numbered queries: each applies its operator to whole tables."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tabrecover.llm import (
    block_search,
    bm25,
    bpe,
    chat,
    decontaminate,
    filter_audit,
    minhash_forest,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
    url_filters,
    whitening,
)
from tabrecover.llm.common import stored, table

#: File of the vocabulary; a parameter of the operators.
VOCAB = os.environ.get("LLM_VOCAB", public_tokenizers.path("byte_bpe_50k.json"))
SHARDS = 40
TOP_K = 10
#: Vectors whose ids this divides are queries, and each gets so many neighbours.
QUERY_IDS, NEAREST = 50, 5
#: A conversation whose texts look like another template's control strings.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"), VOCAB)
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    added = spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")
    packed = stored(chat.packs(table(spark, sf_dir, "conversations").select(columns).unionByName(added)))
    return chat.read_back(packed)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filters.judge(pages, rules, url_filters.html_links(pages)).drop("alias")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), as_text=False)
    return found.withColumnRenamed("kept", "kept_sha256")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, lexicon)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), VOCAB, outputs="digest")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.ring_shards(table(spark, sf_dir, "documents"), SHARDS)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bm25.search(bm25.build(docs), docs.filter(F.col("doc_id") % 50 == 0), k=TOP_K).withColumn("score", F.round("score", 6))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = block_search.tiles(table(spark, sf_dir, "embeddings"))
    return block_search.search(packed, block_search.is_query(QUERY_IDS), k=NEAREST)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_forest": op3_minhash_forest,
    "op4_chat_tree": op4_chat_tree,
    "op5_url_filters": op5_url_filters,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_sharding": op9_sharding,
    "op10_topk_search": op10_topk_search,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_nearest": op13_nearest,
    "pipeline": corpus_pipeline.run,
}
