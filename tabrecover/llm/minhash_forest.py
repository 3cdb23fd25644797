"""Near duplicates by an LSH forest over MinHash signatures.

Every distinct set of five-word shingles gets ``TREES`` labels of ``DEPTH``
MinHash values. For each tree the labels are sorted, so sets with a long common
prefix lie side by side; a run of equal first ``LEAST`` values is a region. A
region of few sets gives all its pairs, a larger one is split by its next value,
and so on, which makes the depth follow the crowd; neighbours in the order are
always paired. Each tree is sorted by range with the set as the last key, so a
region of any size is spread over tasks, and what a border cuts is paired again
from the few rows on either side of it.

Pairs are confirmed on the full sets, and linked sets become components. Then
regions too large for all their pairs, if they hold several components, compare
the whole signatures of sets of different components. A set that may be similar enough to
one of another component goes on with its shingles, and the task that compares it confirms
pairs at once: it gives out links that join two components, at most one per set,
and no row for a pair that is rejected or already joined. A region of any size is compared whole: it
is cut into blocks, and each pair of blocks that holds two components is a task.

Documents with equal sets are one node from the start, so a hot text costs one
row. Defined results: no words means an empty set, linked with nothing; rows
with a null id are left alone (component null, kept); repeated rows are equal
sets, and rows of one id with different sets are one node, linked if any of them is; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrecover.llm.common import stored, tidied
from tabrecover.llm.components import components
from tabrecover.llm.shingles import shingle_set
from tabrecover.plans.joins import salted_join

#: Trees, values of a label, and the fewest equal first values of a region.
TREES, DEPTH, LEAST = 20, 8, 4
#: Sets of a region whose pairs are all taken; of equal labels each meets so many next ones.
CROWD, NEXT = 8, 3
#: Sets within so many places of a partition's border are looked at again.
SEAM = 16
#: Points of a hundred by which two signatures may fall short of the similarity asked for (three deviations and more).
SLACK = 9
#: Sets of a block, where one of more than ``UNIT`` shingles counts as several: a larger crowd is compared block against block.
MEETING, UNIT = 8192, 512

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def signature(hashes: np.ndarray) -> bytes:
    """Smallest value of every permutation, big-endian so that bytes sort as numbers."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 1024):
        part = x[start : start + 1024]
        np.minimum(least, (part[:, None] * _A + _B).min(axis=0), out=least)
    return least.astype(">u4").tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, high, low, labels = [], [], [], []
        for text in batch.column("text").to_pylist():
            found = shingle_set(text)
            key = xxhash.xxh3_128_digest(found.tobytes())
            sizes.append(len(found))
            high.append(int.from_bytes(key[:8], "big", signed=True))
            low.append(int.from_bytes(key[8:], "big", signed=True))
            labels.append(signature(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(labels, pa.binary())],
            names=["doc_id", "n_shingles", "high", "low", "labels"],
        )


def region_pairs(labels: list[bytes], depth: int = LEAST) -> list[tuple[int, int]]:
    """Pairs of places in a sorted run of labels that agree in their first ``depth`` values."""
    n = len(labels)
    if n <= CROWD:
        return [(i, j) for i in range(n) for j in range(i + 1, n)]
    if depth == DEPTH:
        return [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 1 + NEXT))]
    out = [(i, i + 1) for i in range(n - 1)]
    start = 0
    for i in range(1, n + 1):
        if i == n or labels[i][4 * depth : 4 * depth + 4] != labels[start][4 * depth : 4 * depth + 4]:
            if i - start > 1:
                out += [(start + a, start + b) for a, b in region_pairs(labels[start:i], depth + 1)]
            start = i
    return out


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("label", pa.binary()), ("node", pa.int64())])
_PAIRS_SQL = "a long, b long, tree int, label binary, node long"


def _pairs_of_run(run: list[tuple]) -> list[tuple[int, int]]:
    pairs = [(run[i][2], run[j][2]) for i, j in region_pairs([r[1] for r in run])]
    return [(min(p), max(p)) for p in pairs if p[0] != p[1]]


def _neighbours(seams: bool):
    """Pairs of a partition sorted by tree, label and node; with ``seams`` also the rows near its borders."""

    def out(pairs: list[tuple[int, int]], rows: list[tuple]) -> pa.RecordBatch:
        empty, rest = [None] * len(rows), [None] * len(pairs)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs] + empty, pa.int64()),
                pa.array([p[1] for p in pairs] + empty, pa.int64()),
                pa.array(rest + [r[0] for r in rows], pa.int32()),
                pa.array(rest + [r[1] for r in rows], pa.binary()),
                pa.array(rest + [r[2] for r in rows], pa.int64()),
            ],
            schema=_PAIRS,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        pairs: list[tuple[int, int]] = []
        border: list[tuple] = []
        first = True
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "label", "node")), strict=True):
                if held and (row[0] != held[0][0] or row[1][: 4 * LEAST] != held[0][1][: 4 * LEAST]):
                    pairs += _pairs_of_run(held) if len(held) > 1 else []
                    if first and seams:
                        border += held[:SEAM]
                    first = False
                    held = []
                held.append(row)
            if len(pairs) > 50_000:
                yield out(pairs, [])
                pairs = []
        pairs += _pairs_of_run(held) if len(held) > 1 else []
        if seams and first and len(held) > 2 * SEAM:
            border += held[:SEAM]
        if seams:
            border += held[-2 * SEAM if first else -SEAM :]
        yield out(pairs, border)

    return run


def _candidates(forest: DataFrame) -> DataFrame:
    """``a, b``: pairs of nodes that meet in some tree."""
    order = ["tree", "label", "node"]
    spread = forest.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(spread.mapInArrow(tidied(_neighbours(True)), _PAIRS_SQL))
    inner = found.filter(F.col("a").isNotNull()).select("a", "b")
    # A region meets here with the few rows that borders cut from it, once for each partition it spans.
    seams = found.filter(F.col("a").isNull()).select(*order)
    seams = seams.repartition("tree", F.substring("label", 1, 4 * LEAST)).sortWithinPartitions(*order)
    across = seams.mapInArrow(tidied(_neighbours(False)), _PAIRS_SQL).select("a", "b")
    return inner.unionByName(across).distinct()


def likely_pairs(
    labels: np.ndarray, sizes: np.ndarray, groups: np.ndarray, tree: int, percent: int, first: int = 0
) -> Iterator[tuple[int, int]]:
    """Pairs of places of different groups whose signatures look similar enough.

    ``labels``: one row of all values per set. Sizes rule out pairs exactly. A pair is
    compared at the first tree where its sets meet, so that other trees need not repeat
    it; that holds because every crowd is compared whole.
    With ``first`` only pairs of one of so many first places and one of the others.
    """
    starts = np.ascontiguousarray(labels.reshape(len(labels), TREES, DEPTH)[:, :tree, :LEAST])
    starts = starts.view([("", labels.dtype)] * LEAST)[:, :, 0]
    codes = [np.unique(starts[:, t], return_inverse=True)[1] for t in range(tree)]
    earlier = np.stack(codes, axis=1).astype(np.int32) if codes else np.empty((len(labels), 0), np.int32)
    needed = (percent - SLACK) * TREES * DEPTH
    for i in range(first or len(labels) - 1):
        others = max(first, i + 1)
        rest = np.flatnonzero(groups[others:] != groups[i]) + others
        small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
        rest = rest[100 * small >= percent * large]
        rest = rest[~(earlier[rest] == earlier[i]).any(axis=1)]
        rest = rest[100 * (labels[rest] == labels[i]).sum(axis=1) >= needed]
        yield from ((i, int(j)) for j in rest)


_CROWD_SQL = "tree int, start binary, one string, two string, side boolean, node long, high long, group long, n long, labels binary"
_TASK = ["tree", "start", "one", "two"]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each task, one crowd or two blocks of one; they come sorted by task, side and node."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(row[c] != held[0][c] for c in _TASK):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _likely(held: list[dict], percent: int) -> Iterator[tuple[int, int]]:
    groups = np.array([r["group"] for r in held], np.int64)
    if (groups == groups[0]).all():
        return
    first = sum(not r["side"] for r in held) if held[0]["one"] != held[0]["two"] else 0
    labels = np.frombuffer(b"".join(r["labels"] for r in held), ">u4").astype(np.uint32).reshape(len(held), -1)
    sizes = np.array([r["n"] for r in held], np.int64)
    yield from likely_pairs(labels, sizes, groups, held[0]["tree"], percent, first)


def _strangers(percent: int):
    """Rows of sets with a likely pair in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _meetings(batches):
            met = np.zeros(len(held), bool)
            for i, j in _likely(held, percent):
                met[i] = met[j] = True
            if met.any():
                kinds = [("tree", pa.int32()), ("start", pa.binary()), ("one", pa.string()), ("two", pa.string()), ("side", pa.bool_())]
                kinds += [(c, pa.int64()) for c in ("node", "high", "group", "n")] + [("labels", pa.binary())]
                for start in range(0, len(held), 1024):
                    rows = [held[i] for i in range(start, min(start + 1024, len(held))) if met[i]]
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return run


class _Joined:
    """Sets joined so far in a task."""

    def __init__(self, groups: list[int]) -> None:
        first: dict[int, int] = {}
        self.over = [first.setdefault(g, i) for i, g in enumerate(groups)]

    def root(self, i: int) -> int:
        while self.over[i] != i:
            self.over[i] = self.over[self.over[i]]
            i = self.over[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.over[max(i, j)] = min(i, j)
        return i != j


def joining_links(sets: list[np.ndarray], groups: list[int], likely: Iterator[tuple[int, int]], percent: int) -> Iterator[tuple[int, int]]:
    """Similar pairs of the likely ones (sorted by first place) that join two groups, until there is nothing left to join."""
    values, numbers = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([len(s) for s in sets])
    numbers = np.split(numbers.astype(np.int32), ends[:-1])
    joined = _Joined(groups)
    marked = np.zeros(len(values), bool)
    for i, pairs in itertools.groupby(likely, key=lambda p: p[0]):
        others = [j for _, j in pairs]
        marked[numbers[i]] = True
        for j in others:
            if joined.root(i) == joined.root(j):
                continue
            both = int(np.count_nonzero(marked[numbers[j]]))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and joined.join(i, j):
                yield i, j
        marked[numbers[i]] = False


def _joining(percent: int):
    """Components of a crowd that have a link, confirmed on the sets that come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _meetings(batches):
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in held]
            groups = [r["group"] for r in held]
            links = [(groups[i], groups[j]) for i, j in joining_links(sets, groups, _likely(held, percent), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _crowds(forest: DataFrame, nodes: DataFrame, member: DataFrame) -> DataFrame:
    """Rows of the forest in regions too large for all their pairs, once for each task they are compared in.

    ``tree, start`` name a crowd, ``one, two`` its blocks that meet, and ``side`` says
    whether a row is of the second. A crowd of up to ``MEETING`` sets is one block.
    """
    rows = forest.select("tree", F.substring("label", 1, 4 * LEAST).alias("start"), "node", "high", "weight")
    counts = rows.groupBy("tree", "start").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    large = stored(counts.filter(F.col("n") > CROWD))
    over = F.col("weight") > MEETING
    rows_of = large.select("tree", "start", "n")
    whole = salted_join(rows, large.filter(~over).select("tree", "start"), ["tree", "start"], "left_semi", counts=rows_of)
    whole = whole.select("tree", "start", "node", "high", F.lit("").alias("one"), F.lit("").alias("two"), F.lit(False).alias("side"))
    over = large.filter(over)
    if not over.isEmpty():
        whole = whole.unionByName(_blocks(rows, over, member))
    who = nodes.select(F.col("doc_id").alias("node"), "high", F.col("n_shingles").alias("n"), "labels")
    found = whole.join(who, ["node", "high"]).join(member, "node", "left")
    group = F.coalesce("component", "node").alias("group")
    return found.select(*_TASK, "side", "node", "high", group, "n", "labels")


def _blocks(rows: DataFrame, over: DataFrame, member: DataFrame) -> DataFrame:
    """Rows of the crowds ``over``, once for every pair of blocks that theirs is in.

    A component of more than ``MEETING`` sets has blocks of its own, and these do not meet
    each other; all other sets of a crowd share blocks. So the copies of a row go
    by the sets outside its component, not by the crowd.
    """
    crowd = ["tree", "start"]
    counts = over.select(*crowd, "n")
    rows = salted_join(rows, over.select(*crowd), crowd, "left_semi", counts=counts).join(member, "node", "left")
    rows = stored(rows.select(*crowd, "node", "high", "weight", F.coalesce("component", "node").alias("group")))
    hot = rows.groupBy(*crowd, "group").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("own"))
    hot = stored(hot.filter(F.col("own") > MEETING))
    rest = over.join(hot.groupBy(*crowd).agg(F.sum("own").alias("own")), crowd, "left")
    rest = rest.select(*crowd, (F.col("weight") - F.coalesce("own", F.lit(0))).alias("others"))
    rows = salted_join(rows, hot.select(*crowd, "group", "own"), [*crowd, "group"], "left", counts=hot.drop("own"))
    rows = salted_join(rows, rest, crowd, counts=counts)
    parts = F.greatest(F.ceil(F.coalesce("own", "others") / MEETING), F.lit(1))
    own = F.when(F.col("own").isNotNull(), F.col("group"))
    block = F.concat_ws("/", own.cast("string"), F.pmod(F.xxhash64("node", "high"), parts).cast("string"))
    rows = stored(rows.select(*crowd, "node", "high", own.alias("own"), block.alias("block")))
    blocks = stored(rows.select(*crowd, "own", "block").distinct())
    ones = blocks.select(*crowd, F.col("own").alias("own_one"), F.col("block").alias("one"))
    twos = blocks.select(*crowd, F.col("own").alias("own_two"), F.col("block").alias("two"))
    same = F.coalesce(F.col("own_one") == F.col("own_two"), F.lit(False))
    meet = ones.join(twos, crowd).filter((F.col("one") <= F.col("two")) & ~same)
    meet = meet.select(*crowd, "one", "two", F.explode(F.array_distinct(F.array("one", "two"))).alias("block"))
    found = rows.join(meet, [*crowd, "block"])
    return found.select(*crowd, "node", "high", "one", "two", (F.col("block") != F.col("one")).alias("side"))


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            keep = []
            for text_a, text_b in zip(*(batch.column(c).to_pylist() for c in ("text_a", "text_b")), strict=True):
                if known[0] != text_a:
                    known = (text_a, shingle_set(text_a))
                one, two = known[1], shingle_set(text_b)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    full = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return full.select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked if ``100 * intersection >= percent * union`` of their sets of
    five-word shingles; a component is named by its smallest id, and that row is kept.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(
        source.mapInArrow(tidied(_signed), "doc_id long, n_shingles long, high long, low long, labels binary")
    )
    has_set = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    with_set = signed.filter(has_set)
    classes = stored(
        with_set.groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    )
    own = classes.select(F.col("node").alias("doc_id"), "high", "low")
    nodes = with_set.join(own, ["doc_id", "high", "low"]).dropDuplicates(["doc_id", "high", "low"])
    place = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    label = F.expr(f"substring(labels, tree * {4 * DEPTH} + 1, {4 * DEPTH})").alias("label")
    weight = F.ceil(F.col("n_shingles") / UNIT).cast("long").alias("weight")
    forest = nodes.select(F.col("doc_id").alias("node"), "high", place, "labels", weight).select("tree", label, "node", "high", "weight")

    def texts_of(ends: DataFrame) -> DataFrame:
        return signed_texts(source, own.join(ends.distinct(), "doc_id"))

    tested = stored(_candidates(forest))
    ends = tested.select(F.explode(F.array("a", "b")).alias("doc_id"))
    links = stored(_confirmed(tested, texts_of(ends), percent))
    member = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    crowds = _crowds(forest, nodes, member)
    order = [*_TASK, "side", "node"]
    crowds = crowds.repartition(*_TASK).sortWithinPartitions(*order)
    met = stored(crowds.mapInArrow(tidied(_strangers(percent)), _CROWD_SQL))
    sets = texts_of(met.select(F.col("node").alias("doc_id"))).mapInArrow(tidied(_hashed), "node long, high long, shingles binary")
    met = met.join(sets, ["node", "high"]).repartition(*_TASK).sortWithinPartitions(*order)
    joins = stored(met.mapInArrow(tidied(_joining(percent)), "u long, v long"))
    named = classes.join(member, "node", "left")
    named = named.select("high", "low", F.coalesce("component", "node").alias("component_id"))
    if not joins.isEmpty():
        larger = components(joins).select(F.col("node").alias("component_id"), F.col("component").alias("larger"))
        named = salted_join(named, larger, ["component_id"], "left")
        named = named.select("high", "low", F.coalesce("larger", "component_id").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "high", "low", has_set.alias("linkable"))
    joined = salted_join(rows, named, ["high", "low"], "left", counts=classes.select("high", "low", "n"))
    component = F.when(F.col("linkable"), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(text).tobytes() for text in batch.column("text").to_pylist()]
        columns = [batch.column("node"), batch.column("high"), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "high", "shingles"])


def signed_texts(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the wanted ids and sets; rows of one id may have several sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for text, high in zip(batch.column("text").to_pylist(), batch.column("high").to_pylist(), strict=True):
                key = xxhash.xxh3_128_digest(shingle_set(text).tobytes())
                keep.append(int.from_bytes(key[:8], "big", signed=True) == high)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = source.join(wanted.select("doc_id", "high"), "doc_id")
    rows = rows.select("doc_id", "text", "high").mapInArrow(tidied(run), "doc_id long, text string, high long")
    return rows.dropDuplicates(["doc_id", "high"]).select(F.col("doc_id").alias("node"), "high", "text")
