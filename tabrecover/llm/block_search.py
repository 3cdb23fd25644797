"""Exact nearest neighbours by cosine as a block matrix join.

Vectors are packed into tiles of ``TILE`` rows. A tile holds the vectors and, for each,
an int8 code of its unit vector, the code's step, and the length of what the code leaves out. Queries
are packed the same way and dealt into buckets, candidate tiles into groups; the grid of
buckets and groups is the join: every candidate tile goes to its group once for each bucket,
every query tile to its bucket once for each group. Rows of a cell come queries first, so a
task holds one bucket and one tile at a time, whatever the table's size.

Two codes multiply as one matrix product of small whole numbers, exact in floats. By
Cauchy-Schwarz the true cosine differs from it by at most ``|q'| r + s``, with q' the query's code
and s, r the lengths left out of either. A pair whose upper bound is below the k-th lower bound,
or the k-th score so far, is done with; survivors are computed in double precision from
the vectors and join the k best of their query. A cell gives one short sorted list per query, and these
lists are merged by a heap. Nothing is lost: bounds hold for every pair, and vectors that are
all alike are compared in the task and not sent on.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite entries take no part; only vectors of
one length are compared; a row is no candidate of its own, while other rows with its id or its vector are; a row
without an id is a candidate (behind equal scores with an id) but no query; each repeated query row has its own results, and fewer
candidates than k are all returned; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrecover.llm.common import stored, tidied

#: Rows of a tile, bytes of a bucket of queries, and tiles of a group at most (where there are more than ``GROUPS`` tiles).
TILE, BUCKET, GROUP, GROUPS = 2048, 16 << 20, 64, 64
#: Queries compared with a tile at once, and surviving pairs computed at once.
BLOCK, PAIRS = 512, 1 << 15
#: Codes reach from -127 to 127; products of so many dimensions are exact in single precision.
_STEPS, _SINGLE = 127, 1040
#: Room for the rounding of norms and scores, far above it.
_ROUND = 1e-9

_TILE = pa.schema(
    [
        ("tile", pa.string()),
        ("size", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("places", pa.list_(pa.int32())),
        ("codes", pa.binary()),
        ("steps", pa.binary()),
        ("left", pa.binary()),
        ("vectors", pa.binary()),
    ]
)
_TILE_SQL = "tile string, size int, ids array<long>, places array<int>, codes binary, steps binary, left binary, vectors binary"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("vector").isNotNull() & fine & F.exists("vector", lambda c: c != 0))


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, steps and left-out lengths of rows: unit vectors are ``step * code`` up to that length."""
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    steps = np.abs(unit).max(axis=1) / _STEPS
    codes = np.rint(unit / steps[:, None]).astype(np.int8)
    left = np.sqrt(((unit - codes * steps[:, None]) ** 2).sum(axis=1)) + 1e-12
    return codes, steps, left


def _row(size: int, tile: str, ids: list, places: list[int], x: np.ndarray, codes: np.ndarray, steps: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
    short = x.astype(np.float32)
    kept = short if (short == x).all() else x
    values = [[tile], [size], [ids], [places], [codes.tobytes()], [steps.tobytes()], [left.tobytes()], [kept.tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, _TILE, strict=True)], schema=_TILE)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[list, list[np.ndarray]]] = {}

    def tile(size: int) -> pa.RecordBatch:
        ids, parts = held.pop(size)
        x = np.concatenate(parts)
        # A power of two changes no cosine and keeps squares within range.
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
        return _row(size, uuid.uuid4().hex, ids, list(range(len(x))), x, *coded(x))

    for batch in batches:
        lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(lengths).tolist():
            part = batch.filter(pa.array(lengths == size))
            x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            names = part.column("vec_id").to_pylist()
            for start in range(0, len(x), TILE):
                ids, parts = held.setdefault(size, ([], []))
                if ids and len(ids) + len(x[start : start + TILE]) > TILE:
                    yield tile(size)
                    ids, parts = held.setdefault(size, ([], []))
                ids += names[start : start + TILE]
                parts.append(x[start : start + TILE])
    for size in list(held):
        yield tile(size)


class Tile:
    """A tile's rows as arrays."""

    def __init__(self, row: dict) -> None:
        self.tile, size, n = row["tile"], row["size"], len(row["ids"])
        self.ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        self.nameless = np.array([i is None for i in row["ids"]], bool)
        self.places = np.array(row["places"], np.int64)
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(n, size)
        self.steps, self.left = np.frombuffer(row["steps"]), np.frombuffer(row["left"])
        kind = np.float32 if len(row["vectors"]) == 4 * n * size else np.float64
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(n, size).astype(np.float64)

    def factors(self) -> np.ndarray:
        return self.codes.astype(np.float32 if self.codes.shape[1] <= _SINGLE else np.float64)


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(_dots(x, x))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed in the order of the entries, so that equal pairs have equal scores anywhere."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def cosines(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    return _dots(a, b) / (of_a * of_b)


class Bucket:
    """The queries of a cell and the best candidates of each so far."""

    def __init__(self, tiles: list[Tile], k: int) -> None:
        self.k = k
        self.tiles = [t.tile for t in tiles for _ in t.ids]
        self.ids = np.concatenate([t.ids for t in tiles])
        self.places = np.concatenate([t.places for t in tiles])
        self.factors = np.concatenate([t.factors() for t in tiles])
        self.steps = np.concatenate([t.steps for t in tiles])
        self.left = np.concatenate([t.left for t in tiles])
        self.vectors = np.concatenate([t.vectors for t in tiles])
        self.lengths = lengths(self.vectors)
        n = len(self.ids)
        self.scores = np.full((n, k), -np.inf)
        self.found = np.zeros((n, k), np.int64)
        self.nameless = np.ones((n, k), bool)
        self.computed = 0

    def meet(self, tile: Tile) -> None:
        factors, of_tile = tile.factors(), lengths(tile.vectors)
        own = np.array([t == tile.tile for t in self.tiles])
        at = {p: i for i, p in enumerate(tile.places.tolist())}
        for start in range(0, len(self.ids), BLOCK):
            block = slice(start, start + BLOCK)
            near = (self.factors[block] @ factors.T).astype(np.float64)
            near *= self.steps[block, None]
            near *= tile.steps
            for i in np.flatnonzero(own[block]):
                near[i, at[int(self.places[start + i])]] = -np.inf
            wide = (1 + self.left[block, None]) * tile.left + self.left[block, None] + _ROUND
            floor = self.scores[block, -1]
            if near.shape[1] >= self.k:
                floor = np.maximum(floor, np.partition(near - wide, -self.k, axis=1)[:, -self.k])
            one, two = np.nonzero((near + wide >= floor[:, None] - _ROUND) & (near > -np.inf))
            if len(one):
                self._take(start + one, two, tile, of_tile)

    def _take(self, one: np.ndarray, two: np.ndarray, tile: Tile, of_tile: np.ndarray) -> None:
        self.computed += len(one)
        scores = np.empty(len(one))
        for start in range(0, len(one), PAIRS):
            i, j = one[start : start + PAIRS], two[start : start + PAIRS]
            scores[start : start + PAIRS] = cosines(self.vectors[i], tile.vectors[j], self.lengths[i], of_tile[j])
        touched = np.unique(one)
        held = self.scores[touched].ravel()
        query = np.concatenate([np.repeat(touched, self.k), one])
        score = np.concatenate([held, scores])
        ids = np.concatenate([self.found[touched].ravel(), tile.ids[two]])
        nameless = np.concatenate([self.nameless[touched].ravel(), tile.nameless[two]])
        order = np.lexsort((ids, nameless, -score, query))
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        best = order[nth < self.k]
        self.scores[touched] = score[best].reshape(-1, self.k)
        self.found[touched] = ids[best].reshape(-1, self.k)
        self.nameless[touched] = nameless[best].reshape(-1, self.k)

    def results(self) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())]))
        for start in range(0, len(self.ids), 4096):
            rows = range(start, min(start + 4096, len(self.ids)))
            lists = []
            for r in rows:
                triples = zip(self.scores[r].tolist(), self.found[r].tolist(), self.nameless[r].tolist(), strict=True)
                lists.append([{"score": s, "vec_id": None if no else i} for s, i, no in triples if s > -np.inf])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.tiles[r] for r in rows], pa.string()),
                    pa.array([int(self.places[r]) for r in rows], pa.int32()),
                    pa.array([int(self.ids[r]) for r in rows], pa.int64()),
                    pa.array(lists, kind),
                ],
                names=["tile", "place", "query_id", "best"],
            )


_BEST_SQL = "tile string, place int, query_id long, best array<struct<score: double, vec_id: long>>"


def _cells(k: int):
    """The best candidates of every query in every cell; rows come sorted by cell, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, bucket = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                key = (row["size"], row["bucket"], row["group"])
                if key != cell:
                    if bucket:
                        yield from bucket.results()
                    cell, queries, bucket = key, [], None
                tile = Tile(row)
                if not row["side"]:
                    queries.append(tile)
                elif queries or bucket:
                    bucket = bucket or Bucket(queries, k)
                    queries = []
                    bucket.meet(tile)
        if bucket:
            yield from bucket.results()

    return run


def _merged(k: int):
    """The k best of the lists of a query; lists come sorted by query."""

    def key(entry: dict) -> tuple:
        return (-entry["score"], entry["vec_id"] is None, entry["vec_id"] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out(rows: list[dict]) -> pa.RecordBatch:
            best = [e for _, e in zip(range(k), heapq.merge(*(r["best"] for r in rows), key=key))]
            return pa.RecordBatch.from_pylist(
                [{"query_id": rows[0]["query_id"], "rank": n + 1, "vec_id": e["vec_id"], "score": e["score"]} for n, e in enumerate(best)],
                schema=pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())]),
            )

        done: list[pa.RecordBatch] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["tile"], row["place"]) != (held[0]["tile"], held[0]["place"]):
                    done.append(out(held))
                    held = []
                held.append(row)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done = []
        if held:
            yield out(held)

    return run


def _queries(wanted: str):
    """Rows of tiles that are queries, as smaller tiles that keep their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tile, mark = Tile(row), np.array(row[wanted], bool)
                if mark.any():
                    ids = tile.ids[mark].tolist()
                    yield _row(row["size"], tile.tile, ids, tile.places[mark].tolist(), tile.vectors[mark], tile.codes[mark], tile.steps[mark], tile.left[mark])

    return run


def tiles(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """All rows that take part, packed; stored, so that a row's tile and place are its identity from here on."""
    return stored(usable(vectors, id_col, vec_col).mapInArrow(tidied(_packed), _TILE_SQL))


def is_query(every: int) -> Column:
    """Marks of a tile's rows whose id is divisible by ``every``."""
    return F.transform("ids", lambda i: F.coalesce(i % every == 0, F.lit(False)))


def search(packed: DataFrame, wanted: Column, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest of every query, nearest first.

    ``packed`` comes from ``tiles``; ``wanted`` gives one boolean per row of a tile that says which are queries.
    """
    asked = stored(packed.withColumn("wanted", wanted).mapInArrow(tidied(_queries("wanted")), _TILE_SQL))
    weight = F.octet_length("codes") + 9 * F.octet_length("codes") + 64 * F.size("ids")
    sizes = asked.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("bytes")).first()
    buckets = max(1, -(-sizes["bytes"] // BUCKET))
    n_tiles = packed.count()
    groups = max(1, min(n_tiles, max(GROUPS, -(-n_tiles // GROUP))))

    def number(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("tile", F.lit(salt)), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumn("bucket", number(buckets, 1)).withColumn("group", all_of(groups)).withColumn("side", F.lit(0))
    right = packed.withColumn("group", number(groups, 2)).withColumn("bucket", all_of(buckets)).withColumn("side", F.lit(1))
    cell = ["size", "bucket", "group"]
    grid = left.unionByName(right).repartition(*cell).sortWithinPartitions(*cell, "side", "tile")
    best = grid.mapInArrow(tidied(_cells(k)), _BEST_SQL)
    one = ["tile", "place"]
    best = best.repartition(*one).sortWithinPartitions(*one)
    return best.mapInArrow(tidied(_merged(k)), "query_id long, rank int, vec_id long, score double")
