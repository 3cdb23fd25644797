"""PCA whitening of vectors: exact covariance, spectral divide and conquer, broadcast projection.

Entries become whole numbers (``floor(64 c) + 1000000``), so counts, sums and products can be
added up exactly, in any order of tasks, and a task that runs again changes nothing. The
first pass gives the number of vectors and the sum of each dimension. The second takes the
nearest whole number to the mean off each entry before it multiplies; the rest of less than one unit
goes off the sums as a fraction of integers. Every covariance is thus the double
nearest to its true value. Its components come from ``spectral`` (polar factors of the shifted covariance,
projectors, ever smaller invariant subspaces); this matrix, one cell for each pair of dimensions, is all that
the driver holds. Centre and components are broadcast, and a vector is projected where it is read.

Defined results: a vector that is null, empty, or holds a null, a NaN, an infinite entry or one beyond 2 ** 40 (whose
products would leave whole numbers) is dropped; where lengths differ those of the most frequent length (then the
longest) stay; repeated rows and ids count each time, rows without an id have a null id; directions without variance
are no components, so equal vectors, a single one and an empty table give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrecover.llm.common import stored, tidied
from tabrecover.llm.spectral import eigen

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
_LARGEST = float(1 << 40)
#: Products of entries up to here are exact sums of doubles over a batch.
_ENTRY, _ROWS = 1 << 20, 1 << 13
_LIMB = 16
_WHOLE = pa.decimal128(38, 0)


@dataclass
class Whitening:
    """A fitted model: whole-number sums, and the components with their variances, largest first."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    @property
    def middle(self) -> list[int]:
        """Whole numbers nearest to the means."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums] if self.n else []

    @property
    def rest(self) -> list[int]:
        """What the sums exceed n times the middle by."""
        return [s - self.n * m for s, m in zip(self.sums, self.middle, strict=True)]


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, vector`` of the rows that take part, whatever their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < _LARGEST))
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)


def whole(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """Entries of a batch of equally long vectors as whole numbers."""
    values = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return np.floor(values.reshape(-1, size) * SCALE).astype(np.int64) + OFFSET


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
        for size in np.unique(lengths).tolist():
            part = whole(batch.filter(pa.array(lengths == size)), size)
            n, total = found.get(size, (0, np.zeros(size, object)))
            found[size] = (n + len(part), total + part.sum(axis=0).astype(object))
    for size, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([size] * size, pa.int32()),
                pa.array(range(size), pa.int32()),
                pa.array([n] * size, pa.int64()),
                pa.array([Decimal(int(t)) for t in total], _WHOLE),
            ],
            names=["size", "place", "n", "total"],
        )


def products(x: np.ndarray) -> np.ndarray:
    """Exact ``x.T @ x`` of whole numbers, as Python integers where 64 bits could be left."""
    largest = int(np.abs(x).max(initial=0))
    if largest <= _ENTRY:
        floats = x.astype(np.float64)
        out = np.zeros((x.shape[1], x.shape[1]), np.int64)
        for start in range(0, len(x), _ROWS):
            part = floats[start : start + _ROWS]
            out += (part.T @ part).astype(np.int64)
        return out
    sign, rest, limbs = np.sign(x), np.abs(x), []
    while rest.any():
        limbs.append((sign * (rest & ((1 << _LIMB) - 1))).astype(np.float64))
        rest = rest >> _LIMB
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            for start in range(0, len(x), _ROWS):
                part = a[start : start + _ROWS].T @ b[start : start + _ROWS]
                out = out + part.astype(np.int64).astype(object) * (1 << _LIMB * (i + j))
    return out


def _scatter(middle: list[int]):
    centre = np.array(middle, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(centre)
        total = np.zeros((size, size), object)
        held, bound = np.zeros((size, size), np.int64), 0
        for batch in batches:
            x = whole(batch, size) - centre
            largest = int(np.abs(x).max(initial=0))
            if largest > _ENTRY:
                total = total + products(x)
                continue
            bound += len(x) * largest * largest
            if bound >= 1 << 62:
                total, held, bound = total + held.astype(object), np.zeros_like(held), len(x) * largest * largest
            held += products(x)
        total = total + held.astype(object)
        for i in range(size):
            if total[i, i]:  # a dimension without deviations has no products either
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i] * (size - i), pa.int32()),
                        pa.array(range(i, size), pa.int32()),
                        pa.array([Decimal(int(t)) for t in total[i, i:]], _WHOLE),
                    ],
                    names=["i", "j", "total"],
                )

    return run


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fit on all ``usable`` rows."""
    totals = rows.mapInArrow(tidied(_totals), "size int, place int, n long, total decimal(38,0)")
    totals = stored(totals.groupBy("size", "place").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")))
    common = totals.filter(F.col("place") == 0).orderBy(F.desc("n"), F.desc("size")).first()
    if common is None:
        return Whitening(0, [], np.empty((0, 0)), np.empty(0), 0.0)
    found = totals.filter(F.col("size") == common["size"]).orderBy("place").collect()
    model = Whitening(common["n"], [int(r["total"]) for r in found], np.empty((0, 0)), np.empty(0), 0.0)
    size, n, rest = model.dimension, model.n, model.rest
    sums = _of_length(rows, size).mapInArrow(tidied(_scatter(model.middle)), "i int, j int, total decimal(38,0)")
    cells = {(r["i"], r["j"]): int(r["total"]) for r in sums.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()}
    exact = [[n * cells.get((min(i, j), max(i, j)), 0) - rest[i] * rest[j] for j in range(size)] for i in range(size)]
    covariance = np.array([[c / (n * n) for c in row] for row in exact])
    values, vectors = eigen(covariance)
    kept = int((values > values[0] * size * np.finfo(float).eps).sum()) if values[0] > 0 else 0
    kept = min(kept, components)
    model.components, model.variances = vectors[:, :kept], values[:kept]
    model.trace = sum(exact[i][i] for i in range(size)) / (n * n)
    return model


def _of_length(rows: DataFrame, size: int) -> DataFrame:
    return rows.filter(F.size("vector") == size)


class _Projection:
    """What a task needs of a model."""

    def __init__(self, model: Whitening) -> None:
        self.n, self.size = model.n, model.dimension
        self.middle = np.array(model.middle, np.int64)
        self.rest = model.rest
        self.fraction = np.array([r / model.n for r in model.rest])
        self.matrix = model.components / np.sqrt(model.variances)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) - self.fraction) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of ``(n x - S) ** 2`` of each row; none where a long cannot hold it."""
        z = x - self.middle
        largest = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest))
        if self.size * largest * largest < 1 << 63:
            return ((self.n * z - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        found = ((self.n * z.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in found]


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened`` of every row that fits the model, one entry per component."""
    spark = rows.sparkSession
    schema = "vec_id long, deviation long, whitened array<double>"
    if not len(model.variances):
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(_Projection(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        width = own.matrix.shape[1]
        for batch in batches:
            x = whole(batch, own.size)
            flat = pa.array(np.ascontiguousarray(own.whitened(x)).ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(own.deviations(x), pa.int64()), lists], names=["vec_id", "deviation", "whitened"]
            )

    return _of_length(rows, model.dimension).mapInArrow(tidied(run), schema)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, measured on all rows.

    Each task centres its rows by their own mean before it multiplies; what the means of
    tasks differ by from the mean of all is added from one small row per task.
    """
    if not len(model.variances):
        return None
    sent = rows.sparkSession.sparkContext.broadcast(_Projection(model))
    width = len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            w = sent.value.whitened(whole(batch, sent.value.size))
            if not len(w):
                continue
            own = w.mean(axis=0)
            apart = own - mean
            both = n + len(w)
            scatter += (w - own).T @ (w - own) + n * len(w) / both * np.outer(apart, apart)
            mean, n = mean + apart * (len(w) / both), both
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([scatter.ravel().tolist()], pa.list_(pa.float64()))],
                names=["n", "mean", "scatter"],
            )

    found = _of_length(rows, model.dimension).mapInArrow(tidied(run), "n long, mean array<double>, scatter array<double>")
    found = stored(found)
    means = found.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg(F.sum(F.col("n") * F.col("m")).alias("m"))
    mean = F.lit([r["m"] / model.n for r in means.orderBy("i").collect()])
    cell = found.select("n", "mean", F.posexplode("scatter").alias("at", "s"))
    i, j = F.expr(f"at div {width}").cast("int"), F.col("at") % width
    apart = [F.get("mean", k) - F.get(mean, k) for k in (i, j)]
    total = cell.groupBy("at").agg(F.sum(F.col("s") + F.col("n") * apart[0] * apart[1]).alias("s")).collect()
    return max(abs(r["s"] / model.n - (r["at"] // width == r["at"] % width)) for r in total)


def explained(model: Whitening) -> list[float]:
    """Share of the whole variance that each component has."""
    return [float(v) / model.trace for v in model.variances]


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row per vector and component."""
    rows = usable(vectors, id_col, vec_col)
    model = fit(rows, components)
    error = identity_error(rows, model)
    found = transform(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.lit(explained(model)) if error is not None else F.lit(None).cast("array<double>")
    return found.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
