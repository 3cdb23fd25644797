"""Repeated passages of a fixed number of words, found with FM-indexes.

A word is removed if it lies in a window of ``WINDOW`` words that also starts in
a document with a smaller id. Windows are dealt out by content: the anchor of a
window is its smallest run of ``GRAM`` words by hash, so equal windows have equal
anchors, and neighbouring windows mostly share one. Stretches of windows with one
anchor are segments. Only anchors seen in two documents go on; then each task
builds FM-indexes over whole anchors of bounded size together, and searches them
backwards for the smallest document of every window.

Equal segments are one row before any index is built. An anchor with more than
``CROWD`` different segments (one passage in many surroundings) is not put into
one index: its windows are told apart by a hash of all their words and grouped
like any key, which gives the same rows.

Defined results: words are those between ASCII white space; null and empty texts
have none; a row with a null id keeps all words and removes none elsewhere; rows
of one id never remove words of each other; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrecover.grid import by_name
from tabrecover.llm.common import stored, tidied
from tabrecover.llm.fm_index import FMIndex
from tabrecover.llm.shingles import rolling, word_hashes, words
from tabrecover.plans.joins import salted_join

#: Words of a window and of the runs that may be its anchor.
WINDOW, GRAM = 50, 10
#: Windows of a segment at most: a longer stretch is cut.
STRETCH = 256
#: Words of an index at most, beyond one anchor.
SHARD_WORDS = 600_000
#: Different segments of an anchor that are indexed together at most.
CROWD = 4096


def segments(found: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of every segment."""
    gram = min(GRAM, window)
    grams = rolling(word_hashes(found), gram)
    reach = window - gram + 1
    if len(grams) < reach:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    least, span = grams, 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.append(first, len(least)))
    if (count > STRETCH).any():
        pieces = -(-count // STRETCH)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        whole = np.repeat(count, pieces)
        first = np.repeat(first, pieces) + nth * STRETCH
        count = np.minimum(whole - nth * STRETCH, STRETCH)
        return least[first].view(np.int64), first, count
    return least[first].view(np.int64), first, count


def _key(data: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(data)
    return int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, anchors = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = np.unique(segments(words(text, lower=False), window)[0])
                docs.append(np.full(len(own), doc, np.int64))
                anchors.append(own)
            if docs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(docs)), pa.array(np.concatenate(anchors))], names=["doc_id", "anchor"]
                )

    return run


_SEGMENT = "struct<anchor: bigint, high: bigint, low: bigint, first: int, count: int>"
_PARTED = f"doc_id long, n_words long, kept string, text string, segments array<{_SEGMENT}>"
_APPLIED = "doc_id long, n_words long, n_removed long, kept string"


def _parted(window: int, as_text: bool, rest: list[str]):
    """Rows without a live anchor are done; others keep their text and get their live segments."""
    row_type = pa.list_(
        pa.struct([("anchor", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("first", pa.int32()), ("count", pa.int32())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, kept, texts, found = [], [], [], []
            for text, live in zip(batch.column("text").to_pylist(), batch.column("live").to_pylist(), strict=True):
                own = words(text, lower=False)
                n_words.append(len(own))
                if not live:
                    kept.append(text if as_text else hashlib.sha256(b" ".join(own)).hexdigest())
                    texts.append(None)
                    found.append(None)
                    continue
                rows = []
                anchors, first, count = segments(own, window)
                keep = np.isin(anchors, np.array(live, np.int64))
                for a, f, c in zip(anchors[keep].tolist(), first[keep].tolist(), count[keep].tolist(), strict=True):
                    high, low = _key(b" ".join(own[f : f + c + window - 1]))
                    rows.append({"anchor": a, "high": high, "low": low, "first": f, "count": c})
                kept.append(None)
                texts.append(text)
                found.append(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array(texts, pa.string()),
                    pa.array(found, row_type),
                    *(batch.column(c) for c in rest),
                ],
                names=["doc_id", "n_words", "kept", "text", "segments", *rest],
            )

    return run


def _segment_texts(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("doc_id", pa.int64()), ("words", pa.binary())])
        for batch in batches:
            rows = []
            for doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "segments")), strict=True):
                own = words(text, lower=False)
                for s in found:
                    part = b" ".join(own[s["first"] : s["first"] + s["count"] + window - 1])
                    rows.append((s["anchor"], s["high"], s["low"], doc, part))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

    return run


def _searched(window: int, shard_words: int):
    """Windows of each segment that occur in smaller documents; rows come sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        one: list[tuple] = []
        n_words = 0

        def out() -> pa.RecordBatch:
            docs = [r[3] for r in held]
            index = FMIndex([r[4] for r in held], docs, window)
            removed = [
                np.flatnonzero(least < doc).astype(np.int32).tobytes()
                for least, doc in zip(index.smallest_documents(), docs, strict=True)
            ]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[1] for r in held], pa.int64()),
                    pa.array([r[2] for r in held], pa.int64()),
                    pa.array(removed, pa.binary()),
                ],
                names=["high", "low", "removed"],
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "high", "low", "owner", "words")), strict=True):
                if one and row[0] != one[0][0]:
                    # The only segment of an anchor has no other one to repeat.
                    if len(one) > 1:
                        held += one
                        n_words += sum(len(r[4]) for r in one)
                    one = []
                    if n_words > shard_words:
                        yield out()
                        held, n_words = [], 0
                one.append((*row[:4], row[4].split()))
        held += one if len(one) > 1 else []
        if held:
            yield out()

    return run


def _window_hashes(window: int):
    """Every window of every segment: high and low name the window, seg_high and seg_low the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for high, low, owner, data in zip(*(batch.column(c).to_pylist() for c in ("high", "low", "owner", "words")), strict=True):
                own = data.split()
                for i in range(len(own) - window + 1):
                    rows.append((high, low, owner, i, *_key(b" ".join(own[i : i + window]))))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["seg_high", "seg_low", "owner", "place", "high", "low"],
            )

    return run


def _crowded(rows: DataFrame, window: int) -> DataFrame:
    """As ``_searched``, for anchors with too many segments for one index."""
    spread = rows.select("high", "low", "owner", "words").mapInArrow(
        tidied(_window_hashes(window)), "seg_high long, seg_low long, owner long, place int, high long, low long"
    )
    spread = stored(spread)
    least = spread.groupBy("high", "low").agg(F.min("owner").alias("least"), F.count(F.lit(1)).alias("n"))
    least = stored(least)
    repeated = salted_join(spread, least.drop("n"), ["high", "low"], counts=least.drop("least"))
    repeated = repeated.filter(F.col("least") < F.col("owner"))
    found = repeated.groupBy("seg_high", "seg_low").agg(F.array_sort(F.collect_list("place")).alias("places"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [np.array(p, np.int32).tobytes() for p in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("seg_high"), batch.column("seg_low"), pa.array(places, pa.binary())], names=["high", "low", "removed"]
            )

    return found.mapInArrow(tidied(packed), "high long, low long, removed binary")


def _applied(window: int, as_text: bool, rest: list[str]):
    """Remove the covered words of rows with text, segments and what is to go from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_removed, kept = [], []
            columns = (batch.column(c).to_pylist() for c in ("text", "segments", "gone"))
            for text, found, gone in zip(*columns, strict=True):
                own = words(text, lower=False)
                starts = np.zeros(len(own) + 1, np.int32)
                what = {(g["high"], g["low"]): g["removed"] for g in gone or []}
                for s in found:
                    if (s["high"], s["low"]) not in what:
                        continue
                    removed = what[s["high"], s["low"]]
                    # Null stands for all windows of the segment.
                    places = np.arange(s["count"]) if removed is None else np.frombuffer(removed, np.int32)
                    np.add.at(starts, s["first"] + places, 1)
                    np.add.at(starts, np.minimum(s["first"] + places + window, len(own)), -1)
                covered = np.cumsum(starts[: len(own)]) > 0
                left = b" ".join(w for w, c in zip(own, covered.tolist(), strict=True) if not c)
                n_removed.append(int(covered.sum()))
                if as_text:
                    kept.append(left.decode() if n_removed[-1] else text)
                else:
                    kept.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_words"),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()),
                    *(batch.column(c) for c in rest),
                ],
                names=["doc_id", "n_words", "n_removed", "kept", *rest],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    as_text: bool = True,
    shard_words: int = SHARD_WORDS,
    crowd: int = CROWD,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row, and the columns to carry as ``rest``.

    ``kept`` is the text as it was if nothing goes, else the words left, joined by one space;
    with ``as_text=False`` it is the hex SHA-256 of all words left, joined by one space.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    whole = source
    rest = ["rest"] if carry else []
    if carry:
        others = F.struct(*by_name(carry)).alias("rest")
        whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), others)
    anchors = stored(source.filter(F.col("doc_id").isNotNull()).mapInArrow(tidied(_anchors(window)), "doc_id long, anchor long"))
    seen = anchors.groupBy("anchor").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")
    )
    live = stored(seen.filter(F.col("least") < F.col("most")).select("anchor", "n"))
    by_doc = salted_join(anchors, live.select("anchor"), ["anchor"], "left_semi", counts=live)
    by_doc = by_doc.groupBy("doc_id").agg(F.collect_set("anchor").alias("live"))
    joined = whole.join(by_doc, "doc_id", "left")
    parted = stored(joined.mapInArrow(tidied(_parted(window, as_text, rest)), _with_rest(_PARTED, whole, rest)))
    open_rows = parted.filter(F.col("segments").isNotNull())

    texts = open_rows.select("doc_id", "text", "segments").mapInArrow(
        tidied(_segment_texts(window)), "anchor long, high long, low long, doc_id long, words binary"
    )
    # Equal segments are one row from here on; the first words are those of all of them.
    distinct = texts.groupBy("anchor", "high", "low").agg(
        F.min("doc_id").alias("owner"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n")
    )
    distinct = stored(distinct)
    crowded = stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd))
    indexed = distinct.drop("n")
    has_crowds = not crowded.isEmpty()
    if has_crowds:
        indexed = salted_join(indexed, crowded.select("anchor"), ["anchor"], "left_anti", counts=crowded)
    indexed = indexed.repartition("anchor").sortWithinPartitions("anchor")
    removed = indexed.select("anchor", "high", "low", "owner", "words").mapInArrow(
        tidied(_searched(window, shard_words)), "high long, low long, removed binary"
    )
    if has_crowds:
        rows = salted_join(distinct.drop("n"), crowded.select("anchor"), ["anchor"], "left_semi", counts=crowded)
        removed = removed.unionByName(_crowded(rows, window))

    # What goes from a segment: everything in documents after its owner, in the owner what the search found.
    verdicts = distinct.select("high", "low", "owner", "n").join(removed, ["high", "low"], "left")
    verdicts = stored(verdicts.filter((F.col("n") > 1) | (F.coalesce(F.octet_length("removed"), F.lit(0)) > 0)))
    held = open_rows.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.high", "s.low").distinct()
    held = salted_join(held, verdicts.drop("n"), ["high", "low"], counts=verdicts.select("high", "low", "n"))
    of_owner = F.when(F.col("doc_id") == F.col("owner"), F.col("removed"))
    gone = held.filter((F.col("doc_id") > F.col("owner")) | (F.coalesce(F.octet_length("removed"), F.lit(0)) > 0))
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("high", "low", of_owner.alias("removed"))).alias("gone"))
    result = open_rows.join(gone, "doc_id", "left").mapInArrow(
        tidied(_applied(window, as_text, rest)), _with_rest(_APPLIED, whole, rest)
    )
    none = F.lit(0).cast("long").alias("n_removed")
    done = parted.filter(F.col("segments").isNull()).select("doc_id", "n_words", none, "kept", *rest)
    return done.unionByName(result)


def _with_rest(schema: str, rows: DataFrame, rest: list[str]) -> T.StructType:
    fields = T.StructType.fromDDL(schema).fields
    return T.StructType([*fields, *(rows.schema[c] for c in rest)])
