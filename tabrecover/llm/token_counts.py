"""Token counts of documents without making their ids.

Documents are gathered in blocks of bounded text. A block keeps one sparse
matrix, document by distinct pre-token, and the list of its pre-tokens. The
lists of all blocks are dealt out by pre-token and sorted, so every distinct
pre-token is encoded once in all; its number of pieces goes back to the blocks
that hold it, where a matrix-vector product gives the counts. What is shuffled
is one row per distinct pre-token and block, not one per word.

Defined results: a null text counts as empty (0 bytes, 0 tokens), repeated rows
and null ids stay rows of their own, an empty table gives no rows, columns
other than the id and the text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrecover.llm.common import stored
from tabrecover.llm.vocab import pre_tokens, vocabulary

#: Bytes of text in a block: bounds the memory of a task, and more text per block means fewer rows to shuffle.
BLOCK_BYTES = 32 << 20
#: Numbers of pieces a task holds before it sends them back to their blocks.
HELD = 2_000_000

_BLOCK = "block long, ids array<long>, sizes array<long>, parts array<string>, matrix binary"


def _packed(rows: list[np.ndarray]) -> bytes:
    """Sorted column numbers of each document, repeated ones as often as they occur."""
    out = []
    for columns in rows:
        found, freq = np.unique(columns, return_counts=True)
        steps = np.diff(found, prepend=0).astype(np.uint32)
        out.append(np.array([len(found)], np.uint32).tobytes() + steps.tobytes() + freq.astype(np.uint32).tobytes())
    return _zipped(np.frombuffer(b"".join(out), np.uint32))


def _zipped(values: np.ndarray) -> bytes:
    """Small whole numbers; bytes of equal weight side by side compress far better."""
    raw = np.ascontiguousarray(values, np.uint32).view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(raw).tobytes(), 1)


def _unzipped(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T
    return np.ascontiguousarray(raw).view(np.uint32).ravel().astype(np.int64)


def _sums(matrix: bytes, weights: np.ndarray, n: int) -> list[int]:
    values = _unzipped(matrix)
    out, at = [], 0
    for _ in range(n):
        k = int(values[at])
        columns = np.cumsum(values[at + 1 : at + 1 + k])
        out.append(int(weights[columns] @ values[at + 1 + k : at + 1 + 2 * k]))
        at += 1 + 2 * k
    return out


def _blocks(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, sizes, rows, held = [], [], [], 0
        places: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([list(places)], pa.list_(pa.string())),
                    pa.array([_packed(rows)], pa.binary()),
                ],
                names=["block", "ids", "sizes", "parts", "matrix"],
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = pre_tokens(text or "")
                for p in parts:
                    if p not in places:
                        places[p] = len(places)
                rows.append(np.fromiter(map(places.__getitem__, parts), np.int64, len(parts)))
                ids.append(doc)
                sizes.append(len((text or "").encode()))
                held += sizes[-1]
                if held >= limit:
                    yield out()
                    block += 1
                    ids, sizes, rows, held, places = [], [], [], 0, {}
        if ids:
            yield out()

    return run


def _counted(path: str):
    """Pieces of sorted pre-tokens, sent back as packed places and numbers for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        last, pieces = None, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_held = 0

        def packed() -> pa.RecordBatch:
            block, place, count = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((place, block))
            block, place, count = block[order], place[order], count[order]
            starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            rows = [
                (int(b[0]), _zipped(np.diff(p, prepend=0)), _zipped(c))
                for b, p, c in zip(*(np.split(x, starts[1:]) for x in (block, place, count)), strict=True)
            ]
            types = [pa.int64(), pa.binary(), pa.binary()]
            columns = zip(zip(*rows, strict=True), types, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["block", "places", "pieces"])

        for batch in batches:
            parts = batch.column("part").to_pylist()
            new = [p for i, p in enumerate(parts) if p != (parts[i - 1] if i else last)]
            counts = iter(vocab.count(new))
            out = []
            for p in parts:
                if p != last:
                    last, pieces = p, next(counts)
                out.append(pieces)
            held.append((batch.column("block").to_numpy(), batch.column("place").to_numpy(), np.array(out, np.int64)))
            n_held += len(out)
            if n_held >= HELD:
                yield packed()
                held, n_held = [], 0
        if held:
            yield packed()

    return run


def token_counts(
    docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row.

    ``vocab_path`` names a byte-level tokenizer file that every executor can read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stored(source.mapInArrow(_blocks(block_bytes), _BLOCK))
    lists = blocks.select("block", F.posexplode("parts").alias("place", "part"))
    lists = lists.repartition("part").sortWithinPartitions("part")
    pieces = lists.mapInArrow(_counted(vocab_path), "block long, places binary, pieces binary")

    def summed(block: pa.Table, found: pa.Table) -> pa.Table:
        places = [np.cumsum(_unzipped(p)) for p in found.column("places").to_pylist()]
        weights = np.zeros(sum(map(len, places)), np.int64)
        for place, count in zip(places, found.column("pieces").to_pylist(), strict=True):
            weights[place] = _unzipped(count)
        ids = block.column("ids").to_pylist()[0]
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "n_bytes": pa.array(block.column("sizes").to_pylist()[0], pa.int64()),
                "n_tokens": pa.array(_sums(block.column("matrix").to_pylist()[0], weights, len(ids)), pa.int64()),
            }
        )

    matrices = blocks.select("block", "ids", "sizes", "matrix").groupBy("block")
    return matrices.cogroup(pieces.groupBy("block")).applyInArrow(
        summed, "doc_id long, n_bytes long, n_tokens long"
    )
