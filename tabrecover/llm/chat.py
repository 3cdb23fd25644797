"""Chat formatting with shared prefixes emitted once.

Every turn becomes ``<|role|>``, a line end, its text, ``<|end|>`` and a line end.
Control strings inside roles and texts are broken by a backslash after their
first letter, and backslashes are doubled, which can be undone exactly.

Conversations that begin with the same turns share them. They are sorted by the
hashes of their turns, so a prefix tree comes up depth first, and cut into packs
of bounded size; a pack starts with all turns of its first conversation, and
every later one adds only turns it does not share with the one before. A node is
one turn, with its place in the pack's text, the position id of its first
character (as if its conversation stood alone), the intervals of its ancestors,
which are all it may attend to besides itself, and the span of its text that
counts for the loss if its role is the assistant's. Lengths are in code points.

A conversation of more than ``CHAPTER`` turns is formatted in chapters of that
many turns, so no row holds more. A later chapter goes on with the positions of
the one before, and the chapters before it are an ancestor of all its turns: the
interval from minus their length to 0, places before the pack's text. Chapters
after equal chapters share turns like the first ones do. The turns of a conversation of more
than ``HOT`` are numbered by a range sort, so they spread over tasks.

Defined results: a null text or role is empty; a turn without a conversation id
is a conversation by itself; turns with equal numbers are ordered by role and
text, and repeated rows are repeated turns; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabrecover.llm.common import stored
from tabrecover.plans.positions import with_position

#: Strings that mean something to this template or to other common ones.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LEARNED = "assistant"
#: Characters of a pack (a longer conversation is a pack by itself) and turns of a chapter.
PACK, CHAPTER = 1 << 16, 4096
#: Turns of a conversation that one task puts into order at most.
HOT = 1 << 17
#: Characters that a conversation's entry in a pack counts for, so that copies of one conversation are packed too.
ENTRY = 16

_CONTROL = re.compile(f"(?={'|'.join(map(re.escape, CONTROL))})(.)")
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)


def escaped(text: str) -> str:
    """No control string is left in the result."""
    return _CONTROL.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is emitted, and the span of its text in that."""
    head = f"<|{escaped(role)}|>\n"
    body = escaped(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parsed(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    return [(unescaped(role), unescaped(body)) for role, body in _TURN.findall(text)]


_INTERVAL = pa.struct([("first", pa.int32()), ("end", pa.int32())])
_ANCESTOR = pa.struct([("first", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct(
    [
        ("parent", pa.int32()),
        ("first", pa.int32()),
        ("end", pa.int32()),
        ("position", pa.int64()),
        ("ancestors", pa.list_(_ANCESTOR)),
        ("loss", _INTERVAL),
    ]
)
_ENTRY = pa.struct([("conv_id", pa.int64()), ("alone", pa.int64()), ("chapter", pa.int64()), ("chapters", pa.int64()), ("leaf", pa.int32())])
_PACKS = "text string, nodes array<struct<parent:int, first:int, end:int, position:bigint, ancestors:array<struct<first:bigint, end:bigint>>, loss:struct<first:int, end:int>>>, conversations array<struct<conv_id:bigint, alone:bigint, chapter:bigint, chapters:bigint, leaf:int>>"


class Pack:
    """A stretch of the prefix tree, depth first."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.nodes: list[dict] = []
        self.entries: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []
        self.history: tuple = ()

    def shared(self, turns: list[tuple[str, str]], history: tuple = ()) -> int:
        """Turns that are on the path of the conversation before; ``history`` stands for the chapters before them."""
        if history != self.history:
            return 0
        n = 0
        while n < min(len(turns), len(self.path)) and self.path[n][0] == turns[n]:
            n += 1
        return n

    def add(self, turns: list[tuple[str, str]], entry: dict, base: int = 0, history: tuple = ()) -> None:
        """``base``: characters of the chapters before."""
        del self.path[self.shared(turns, history) :]
        self.history = history
        for turn in turns[len(self.path) :]:
            text, start, end = formatted(*turn)
            ancestors: list[dict] = [{"first": -base, "end": 0}] if base else []
            parent, position = -1, base
            if self.path:
                parent = self.path[-1][1]
                up = self.nodes[parent]
                position = up["position"] + up["end"] - up["first"]
                ancestors = [dict(a) for a in up["ancestors"]]
                if ancestors and ancestors[-1]["first"] >= 0 and ancestors[-1]["end"] == up["first"]:
                    ancestors[-1]["end"] = up["end"]
                else:
                    ancestors.append({"first": up["first"], "end": up["end"]})
            loss = {"first": self.size + start, "end": self.size + end} if turn[0] == LEARNED else None
            self.path.append((turn, len(self.nodes)))
            self.nodes.append(
                {"parent": parent, "first": self.size, "end": self.size + len(text), "position": position, "ancestors": ancestors, "loss": loss}
            )
            self.parts.append(text)
            self.size += len(text)
        self.entries.append({**entry, "leaf": self.path[-1][1]})

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(["".join(self.parts)], pa.string()),
                pa.array([self.nodes], pa.list_(_NODE)),
                pa.array([self.entries], pa.list_(_ENTRY)),
            ],
            names=["text", "nodes", "conversations"],
        )


def _packed(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = Pack()
        for batch in batches:
            for row in batch.to_pylist():
                turns = [(t["role"], t["text"]) for t in row["turns"]]
                history = (row["chapter"], row["past"], row["past_too"])
                if pack.entries:
                    new = sum(len(r) + len(t) for r, t in turns[pack.shared(turns, history) :])
                    if pack.size + new + ENTRY * len(pack.entries) > limit:
                        yield pack.batch()
                        pack = Pack()
                pack.add(turns, {c: row[c] for c in ("conv_id", "alone", "chapter", "chapters")}, row["base"], history)
        if pack.entries:
            yield pack.batch()

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted length of every chapter instead of its turns."""
    for batch in batches:
        sizes = [sum(len(formatted(t["role"], t["text"])[0]) for t in turns) for turns in batch.column("turns").to_pylist()]
        names = [n for n in batch.schema.names if n != "turns"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sizes, pa.int64())], names=[*names, "size"])


def _pasts(chapters: DataFrame) -> DataFrame:
    """For every later chapter the formatted length and two hashes of the chapters before it."""
    key = ["conv_id", "alone", "chapter"]
    marks = [F.xxhash64(F.lit(k), "chapter", "turns").alias(f"mark{k}") for k in (1, 2)]
    sizes = chapters.select(*key, *marks, "turns").mapInArrow(
        _measured, "conv_id long, alone long, chapter long, mark1 long, mark2 long, size long"
    )
    before = Window.partitionBy("conv_id", "alone").orderBy("chapter").rowsBetween(Window.unboundedPreceding, -1)
    past = [F.sum("size").over(before).alias("base"), *(F.bit_xor(f"mark{k}").over(before).alias(n) for k, n in ((1, "past"), (2, "past_too")))]
    return sizes.select(*key, *past).filter(F.col("chapter") > 0)


def _placed(turns: DataFrame, hot: int) -> DataFrame:
    """Turns with their place in their conversation; at most one row per ``hot`` turns is broadcast."""
    order = ["turn", "role", "text"]
    window = Window.partitionBy("conv_id", "alone").orderBy(*order)
    counts = turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    large = stored(counts.filter(F.col("n") > hot).select("conv_id"))
    place = (F.row_number().over(window).cast("long") - 1).alias("place")
    if large.isEmpty():
        return turns.select("conv_id", "alone", "role", "text", place)
    usual = turns.join(F.broadcast(large), "conv_id", "left_anti").select("conv_id", "alone", "role", "text", place)
    sorted_turns = stored(with_position(turns.join(F.broadcast(large), "conv_id", "left_semi"), ["conv_id", *order]))
    starts = sorted_turns.groupBy("conv_id").agg(F.min("pos").alias("start"))
    found = sorted_turns.join(F.broadcast(starts), "conv_id")
    return usual.unionByName(found.select("conv_id", "alone", "role", "text", (F.col("pos") - F.col("start")).alias("place")))


def packs(conversations: DataFrame, limit: int = PACK, chapter: int = CHAPTER, hot: int = HOT) -> DataFrame:
    """``text, nodes, conversations``: one row per pack. Input: conv_id, turn, role, text."""
    empty = F.lit("")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.col("turn").alias("turn"),
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    )
    chapters = _placed(turns, hot).groupBy("conv_id", "alone", F.floor(F.col("place") / chapter).alias("chapter")).agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns")
    )
    chapters = stored(chapters)
    counts = chapters.groupBy("conv_id", "alone").agg(F.count(F.lit(1)).alias("chapters"))
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.alone").eqNullSafe(F.col("b.alone"))
    rows = chapters.alias("a").join(counts.alias("b"), same).select("a.*", "b.chapters")
    zero = F.lit(0).cast("long")
    later = rows.filter(F.col("chapters") > 1)
    if later.isEmpty():
        rows = rows.select("*", *(zero.alias(c) for c in ("base", "past", "past_too")))
    else:
        pasts = stored(_pasts(later))
        same = same & (F.col("a.chapter") == F.col("b.chapter"))
        found = rows.alias("a").join(pasts.alias("b"), same, "left")
        rows = found.select("a.*", *(F.coalesce(f"b.{c}", zero).alias(c) for c in ("base", "past", "past_too")))
    hashes = F.transform("turns", lambda t: F.hex(F.xxhash64(t["role"], t["text"])))
    # Later chapters stay apart from first ones: no turn hash begins with the letter Z.
    past = F.concat(F.lit("Z"), F.lpad(F.col("chapter").cast("string"), 12, "0"), *(F.lpad(F.hex(c), 16, "0") for c in ("past", "past_too")))
    path = F.array_join(F.transform(hashes, lambda h: F.lpad(h, 16, "0")), "")
    path = F.when(F.col("chapter") > 0, F.concat(past, path)).otherwise(path)
    rows = rows.select("conv_id", "alone", "chapter", "chapters", "base", "past", "past_too", "turns", path.alias("path"))
    keys = ["path", "conv_id", "alone", "chapter"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("path")
    return rows.mapInArrow(_packed(limit), _PACKS)


def conversation_text(pack: dict, leaf: int) -> str:
    """What the last turn of a conversation may look at in its pack, and itself: the whole conversation, or its chapter."""
    node = pack["nodes"][leaf]
    spans = [*(a for a in node["ancestors"] if a["first"] >= 0), node]
    return "".join(pack["text"][s["first"] : s["end"]] for s in spans)


def learned_texts(pack: dict, leaf: int) -> list[str]:
    """Texts under the loss mask of a conversation, in order."""
    out = []
    while leaf >= 0:
        node = pack["nodes"][leaf]
        if node["loss"]:
            out.append(unescaped(pack["text"][node["loss"]["first"] : node["loss"]["end"]]))
        leaf = node["parent"]
    return out[::-1]


_READ = "conv_id long, alone long, chapter long, chapters long, n_turns long, turns string, learned string, formatted_chars long"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
    names = [f.split()[0] for f in _READ.split(", ")]
    for batch in batches:
        for pack in batch.to_pylist():
            rows = []
            for entry in pack["conversations"]:
                text = conversation_text(pack, entry["leaf"])
                turns = parsed(text)
                rows.append(
                    (
                        *(entry[c] for c in names[:4]),
                        len(turns),
                        "".join(f"{role}\n{body}\n" for role, body in turns),
                        "".join(learned_texts(pack, entry["leaf"])),
                        len(text),
                    )
                )
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; its chapters come one after the other."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in _DIGESTS.split(", ")]
    state: list | None = None

    def done() -> tuple:
        return (state[0], state[2], state[3].hexdigest(), state[4], state[5].hexdigest(), state[6])

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if state is None or (row["conv_id"], row["alone"]) != (state[0], state[1]):
                if state is not None:
                    out.append(done())
                state = [row["conv_id"], row["alone"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[2] += row["n_turns"]
            state[3].update(row["turns"].encode())
            state[4] += len(row["learned"])
            state[5].update(row["learned"].encode())
            state[6] += row["formatted_chars"]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(done(), types, strict=True)], names=names)


def read_back(packed: DataFrame) -> DataFrame:
    """Per conversation, from the packs alone: number and digest of its turns, size and digest of the text under the loss mask, formatted length."""
    rows = packed.mapInArrow(_read, _READ)
    rows = rows.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", "chapter")
    return rows.mapInArrow(_digested, _DIGESTS)
