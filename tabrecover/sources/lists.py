"""Header lists, target lists and stored mappings."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrecover.functions.text import is_blank, trim_space
from tabrecover.plans.checkpoints import stored
from tabrecover.plans.positions import with_position
from tabrecover.sources.files import filesystem

# The target list a new project starts with.
DEFAULT_TARGETS = ("ID", "Name", "Email", "Phone", "Address", "Date", "Amount", "Description")

# First and last line of a document that is spread over part files.
MAPPING_HEAD, MAPPING_TAIL = '{"mappings":[', "]}"

ENTRY_TYPE = "struct<scanned_column:string,target_column:string,is_ignored:boolean>"
MAPPING_SCHEMA = f"mappings array<{ENTRY_TYPE}>"


def clean_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Trim the lines and drop the blank ones; copies stay."""
    return lines.filter(~is_blank(F.col(text))).withColumn(text, trim_space(F.col(text)))


def read_lines(spark: SparkSession, path: str, name: str = "header") -> DataFrame:
    """Lines of a text file in file order: pos (from 0) and the trimmed text."""
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    )
    numbered = with_position(clean_lines(lines), ["path", "start", "place"])
    return numbered.select("pos", F.col("value").alias(name))


def default_targets(spark: SparkSession) -> DataFrame:
    """The target list of a new project: pos, target."""
    return spark.createDataFrame(list(enumerate(DEFAULT_TARGETS)), "pos bigint, target string")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """The target list at the path, or the default one if nothing is there: pos, target."""
    fs, inner = filesystem(path)
    if fs.get_file_info(inner).type == pafs.FileType.NotFound:
        return default_targets(spark)
    targets = read_lines(spark, path, "target")
    if targets.isEmpty():
        raise ValueError(f"no target columns in {path}")
    return targets


def mapping_entries(documents: DataFrame, doc: Column | None = None) -> DataFrame:
    """Entries of mapping documents in a text column: doc, ord, scanned, target, is_ignored.

    ``ord`` is the place in the document; an absent flag means not ignored.
    """
    doc = F.lit(0) if doc is None else doc
    parsed = F.from_json("text", MAPPING_SCHEMA, {"mode": "FAILFAST"})
    entries = documents.select(doc.cast("bigint").alias("doc"), F.posexplode(parsed["mappings"]).alias("ord", "e"))
    return entries.select("doc", F.col("ord").cast("bigint").alias("ord"), *_entry_columns())


def _entry_columns() -> list[Column]:
    return [
        F.col("e.scanned_column").alias("scanned"),
        F.col("e.target_column").alias("target"),
        F.coalesce("e.is_ignored", F.lit(False)).alias("is_ignored"),
    ]


def _own_lines(line: Column) -> Column:
    """Lines of a document as ``write_mapping`` writes it: an entry, its head or its tail."""
    return line.isin(MAPPING_HEAD, MAPPING_TAIL) | line.rlike(r'^,?\{"scanned_column":.*\}$')


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Stored mapping: doc (0), ord, scanned, target, is_ignored.

    A file holds one JSON document, or lines of the one that ``write_mapping``
    spreads over part files. ``ord`` counts all entries, files in the order of
    their paths. A file with anything after its document is an error.
    """
    at = [
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
    ]
    lines = spark.read.text(path).select(F.trim("value").alias("text"), *at).filter("text <> ''")
    own = lines.groupBy("path").agg(
        F.min(_own_lines(F.col("text"))).alias("own"),
        F.count_if(F.col("text") == MAPPING_HEAD).alias("heads"),
        F.count_if(F.col("text") == MAPPING_TAIL).alias("tails"),
    )
    own = stored(own)
    ends = own.filter("own").agg(F.sum("heads").alias("heads"), F.sum("tails").alias("tails")).first()
    if ends["heads"] != ends["tails"]:
        raise ValueError(f"malformed mapping in {path}: part of a document is missing")
    bodies = lines.join(own.filter("own").select("path"), "path", "left_semi")
    bodies = bodies.filter(~F.col("text").isin(MAPPING_HEAD, MAPPING_TAIL))
    parsed = F.from_json(F.regexp_replace("text", "^,", ""), ENTRY_TYPE, {"mode": "FAILFAST"})
    from_lines = bodies.select("path", "start", "place", parsed.alias("e"))

    # Within an array and an object, text after a document is malformed instead of being passed over.
    texts = spark.read.text(path, wholetext=True).select("value", at[0])
    texts = texts.join(own.filter("not own").select("path"), "path", "left_semi")
    inside = F.concat(F.lit('{"documents":['), "value", F.lit("]}"))
    found = F.from_json(inside, f"documents array<struct<mappings:array<{ENTRY_TYPE}>>>", {"mode": "FAILFAST"})
    whole = texts.select("path", F.posexplode(F.flatten(found["documents"]["mappings"])).alias("place", "e"))
    from_documents = whole.select("path", F.lit(0).cast("bigint").alias("start"), F.col("place").cast("bigint").alias("place"), "e")
    entries = from_lines.unionByName(from_documents).select("path", "start", "place", *_entry_columns())
    numbered = with_position(entries, ["path", "start", "place"], "ord")
    return numbered.select(F.lit(0).cast("bigint").alias("doc"), "ord", "scanned", "target", "is_ignored")
