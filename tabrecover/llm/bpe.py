"""BPE encoding and decoding; long texts are cut, encoded apart and grown together.

Texts up to ``LONG_BYTES`` are encoded where they lie. A longer one is cut in
halves again and again: before a single space if there is one near the middle,
where the split pattern always starts anew, or else anywhere inside a piece of
unsplit text. The leaves are encoded in parallel and joined pair by pair, level by
level. At a join inside unsplit text a window around the join is encoded again
and grows until its first id is the one the left side has there and its last id
the one the right side has there. A sequence of ids is the encoding of its
letters exactly if every two neighbours are, and then all neighbours are: those
within the sides, those within the window, and those across its two ends.

Defined results: a null text is empty (no ids, empty text), repeated rows and
null ids stay rows of their own, an empty table gives no rows, other columns
are not looked at. Only a long text without any usable cut, such as a run of
apostrophes, is encoded in one piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrecover.llm.common import tidied
from tabrecover.llm.vocab import Vocabulary, vocabulary

#: Texts above this size are encoded in parts, each of at most LEAF_CHARS characters.
LONG_BYTES = 32_768
LEAF_CHARS = 16_384
#: Ids on either side of a join that are encoded again first; doubled until both sides agree.
WINDOW = 4

SAFE, INSIDE = 0, 1
_GAP = re.compile(r"(?<=\S) (?=\S)")
_CONTEXT = 64
_TRIES = 256


def _kind_of_cut(vocab: Vocabulary, text: str, at: int) -> int | None:
    """SAFE if a piece starts at ``at``, INSIDE if one unsplit piece spans it, None if a cut there is not usable."""
    for special in vocab.specials:
        if special in text[max(0, at - len(special) + 1) : at + len(special) - 1]:
            return None
        if text.endswith(special, 0, at) or text.startswith(special, at):
            return SAFE
    left, right = text[max(0, at - _CONTEXT) : at], text[at : at + _CONTEXT]
    split = vocab.tokenizer.pre_tokenizer.pre_tokenize_str
    whole, a, b = ([p for p, _ in split(t)] for t in (left + right, left, right))
    if whole == a + b:
        return SAFE
    if whole == [*a[:-1], a[-1] + b[0], *b[1:]]:
        return INSIDE
    return None


def _cut(vocab: Vocabulary, text: str) -> tuple[int, int] | None:
    """Where to halve a text, and the kind of the cut."""
    mid, quarter = len(text) // 2, len(text) // 4
    if found := _GAP.search(text, mid, mid + quarter) or _GAP.search(text, quarter, mid):
        return found.start(), SAFE
    for at in range(mid, min(mid + _TRIES, len(text) - 1)):
        if (kind := _kind_of_cut(vocab, text, at)) is not None:
            return at, kind
    return None


def leaves(vocab: Vocabulary, text: str, limit: int = LEAF_CHARS) -> list[tuple[int, int, int, str]]:
    """Parts of a text as (place, level and kind of the cut before it, part).

    The level is the depth of the cut in the tree of halves: joins are made from the deepest up.
    """
    out = []
    todo = [(text, 0, SAFE, 0)]
    while todo:
        part, level, kind, depth = todo.pop()
        found = _cut(vocab, part) if len(part) > limit else None
        if found is None:
            out.append((len(out), level, kind, part))
        else:
            at, own = found
            todo += [(part[at:], depth, own, depth + 1), (part[:at], level, kind, depth + 1)]
    return out


@dataclass
class Side:
    """Ids of a stretch of text; how many belong to its first and to its last unsplit piece."""

    ids: list[int]
    head: int
    tail: int

    @classmethod
    def of(cls, vocab: Vocabulary, text: str) -> Side:
        found = vocab.tokenizer.encode(text, add_special_tokens=False)
        ids, words = found.ids, found.word_ids
        if not ids:
            return cls([], 0, 0)
        apart = [(w, i) if t in vocab.special_ids else w for i, (t, w) in enumerate(zip(ids, words, strict=True))]
        head = next((i for i, w in enumerate(apart) if w != apart[0]), len(ids))
        tail = next((i for i, w in enumerate(reversed(apart)) if w != apart[-1]), len(ids))
        return cls(ids, head, tail)


def joined(vocab: Vocabulary, left: Side, right: Side, kind: int) -> Side:
    """Ids of the two stretches as one text."""
    if not left.ids or not right.ids:
        return right if not left.ids else left
    if kind == SAFE:
        return Side(left.ids + right.ids, left.head, right.tail)
    w = WINDOW
    while True:
        a, b = min(w, left.tail), min(w, right.head)
        again = left.ids[len(left.ids) - a :] + right.ids[:b]
        ids = [t.id for t in vocab.model.tokenize("".join(vocab.pieces[i] for i in again))]
        if (a == left.tail or ids[0] == again[0]) and (b == right.head or ids[-1] == again[-1]):
            break
        w *= 2
    own = left.tail - a + len(ids) + right.head - b
    all_left, all_right = left.tail == len(left.ids), right.head == len(right.ids)
    return Side(
        left.ids[: len(left.ids) - a] + ids + right.ids[b:],
        own if all_left else left.head,
        own if all_right else right.tail,
    )


def grown_together(vocab: Vocabulary, sides: list[Side], levels: list[int], kinds: list[int]) -> list[int]:
    """Join neighbours from the deepest cut up; ``levels[i]`` and ``kinds[i]`` are of the cut before ``sides[i]``."""
    sides, levels, kinds = list(sides), list(levels), list(kinds)
    for level in range(max(levels[1:], default=-1), -1, -1):
        keep, at_level, of_kind = sides[:1], levels[:1], kinds[:1]
        for side, own, kind in zip(sides[1:], levels[1:], kinds[1:], strict=True):
            if own == level:
                keep[-1] = joined(vocab, keep[-1], side, kind)
            else:
                keep.append(side)
                at_level.append(own)
                of_kind.append(kind)
        sides, levels, kinds = keep, at_level, of_kind
    return sides[0].ids


_IDS, _DIGEST = "ids array<int>", "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: What ``encode`` can return: the ids, digests of the ids and of the text they decode to, or both.
OUTPUTS = {"ids": _IDS, "digest": _DIGEST, "both": f"{_IDS}, {_DIGEST}"}


def _outputs(vocab: Vocabulary, ids: list[np.ndarray], outputs: str) -> list[pa.Array]:
    made = []
    if outputs != "digest":
        made.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
    if outputs != "ids":
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        made += [
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([digest(vocab.joined(i)) for i in ids], pa.string()),
            pa.array([digest(vocab.decode(i)) for i in ids], pa.string()),
        ]
    return made


def encode(
    docs: DataFrame,
    vocab_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: str = "ids",
    long_bytes: int = LONG_BYTES,
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """``doc_id`` and ``ids`` of every row, special strings inside texts as the library takes them.

    ``outputs`` is one of ``OUTPUTS``: with ``digest`` the ids are not carried further,
    the task that has them returns their number and both digests.
    """
    schema = f"doc_id long, {OUTPUTS[outputs]}"
    names = [f.split()[0] for f in schema.split(", ")]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            ids = vocab.ids([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_outputs(vocab, ids, outputs)], names=names)
        vocab.forget()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            for key, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = [(key, doc, *leaf) for leaf in leaves(vocab, text, leaf_chars)]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(part.names, p, strict=True)) for p in parts], schema=part
                )

    part = pa.schema(
        [("key", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32()), ("level", pa.int32()), ("kind", pa.int32()), ("part", pa.string())]
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            sides = [Side.of(vocab, t) for t in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("key", "doc_id", "place", "level", "kind")),
                    pa.array([np.array(s.ids, np.uint32).tobytes() for s in sides], pa.binary()),
                    pa.array([s.head for s in sides], pa.int32()),
                    pa.array([s.tail for s in sides], pa.int32()),
                ],
                names=["key", "doc_id", "place", "level", "kind", "ids", "head", "tail"],
            )

    def grown(rows: pa.Table) -> pa.Table:
        vocab = vocabulary(vocab_path)
        found = rows.sort_by("place").to_pylist()
        sides = [Side(np.frombuffer(r["ids"], np.uint32).tolist(), r["head"], r["tail"]) for r in found]
        ids = grown_together(vocab, sides, [r["level"] for r in found], [r["kind"] for r in found])
        columns = [pa.array([found[0]["doc_id"]], pa.int64()), *_outputs(vocab, [np.array(ids, np.uint32)], outputs)]
        return pa.table(dict(zip(names, columns, strict=True)))

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    is_long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    # The key tells equal rows apart; it is made once, before the parts are dealt out.
    long = source.filter(is_long).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    parts = long.mapInArrow(tidied(cut), "key long, doc_id long, place int, level int, kind int, part string")
    sides = parts.repartition("key", "place").mapInArrow(
        tidied(encoded), "key long, doc_id long, place int, level int, kind int, ids binary, head int, tail int"
    )
    whole = sides.groupBy("key").applyInArrow(grown, schema)
    return source.filter(~is_long).mapInArrow(tidied(short), schema).unionByName(whole)


def decode(rows: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of rows with ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            texts = [vocab.decode(np.array(i or [], np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    source = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(tidied(run), "doc_id long, text string")
