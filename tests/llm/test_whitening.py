"""Whitening against plain integers and a library's eigenvectors."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import SF
from tabrecover.llm import queries, spectral, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n string, total string, place string, vector string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def check(found, rows, components=32):
    """All columns against exact sums and the eigenvectors of the exact covariance."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows]
    n, d = len(kept), len(kept[0][1])
    sums = [sum(x[k] for _, x in kept) for k in range(d)]
    cov = np.array([[float(Fraction(sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for _, x in kept), n**3)) for b in range(d)] for a in range(d)])
    values = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, int((values > values[0] * d * 1e-15).sum()))
    assert len(found) == n * k
    by_component = {}
    for r in found:
        by_component.setdefault(r.component, []).append(r)
    assert sorted(by_component) == list(range(1, k + 1))
    centred = {}
    for i, x in kept:
        centred.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])))
    # A deviation that a long cannot hold is null.
    want = sorted((i, str(dev if dev < 1 << 63 else None)) for i, all_ in centred.items() if i is not None for dev, _ in all_)
    for c, own in by_component.items():
        assert sorted((r.vec_id, str(r.deviation)) for r in own if r.vec_id is not None) == want
        assert all(r.n == n and r.identity_error <= 1e-8 for r in own)
        assert own[0].explained == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
    # The projections span the same components: with the eigenvectors of V, up to the sign.
    gaps = np.abs(np.diff(values, append=-1, prepend=values[0] * 3))
    w, v = np.linalg.eigh(cov)
    v = v[:, ::-1]
    for c in range(k):
        if min(gaps[c], gaps[c + 1]) < 1e-3 * values[0]:
            continue
        want = sorted(abs(float(z @ v[:, c]) / math.sqrt(values[c])) for all_ in centred.values() for _, z in all_)
        assert sorted(abs(r.whitened) for r in by_component[c + 1]) == pytest.approx(want, abs=1e-9)


def test_against_library(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1 + k) + 3 * k for k in range(6)]) for i in range(200)]
    rows += [(7, rows[7][1]), (7, [1.0] * 6), (None, [2.0] * 6)]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] + [1.0] * 5), (904, [math.inf] + [1.0] * 5), (905, [1.0] * 5), (906, [1e300] * 6)]
    found = whitening.whiten(vectors(spark, rows + odd).repartition(5)).collect()
    check(found, rows)
    assert len(whitening.whiten(vectors(spark, rows), components=2).collect()) == 2 * len(rows)


def test_far_and_large(spark):
    """Entries far from zero and beyond the products that doubles hold keep their digits."""
    rng = random.Random(4)
    rows = [(i, [1e9 + rng.random(), rng.gauss(0, 1e6), -5e8 + 40 * rng.random()]) for i in range(60)]
    check(whitening.whiten(vectors(spark, rows)).collect(), rows)


def test_whole_table(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = queries.QUERIES["op11_whitening"](spark, SF)
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    check(found.collect(), rows)


def test_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)], [(1, None)]):
        assert whitening.whiten(vectors(spark, rows)).collect() == []
    flat = [(i, [float(i), 5.0, 2.0 * i]) for i in range(9)]
    assert {r.component for r in whitening.whiten(vectors(spark, flat)).collect()} == {1}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 24), st.sampled_from(["plain", "graded", "twins", "low rank", "equal"]))
def test_spectral(seed, size, kind):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = {
        "plain": rng.standard_normal(size),
        "graded": 10.0 ** -np.linspace(0, 10, size),
        "twins": rng.integers(0, 3, size).astype(float),
        "low rank": np.r_[rng.random(size // 3 + 1), np.zeros(size)][:size],
        "equal": np.full(size, 2.5),
    }[kind]
    a = turn @ np.diag(values) @ turn.T
    a = (a + a.T) / 2
    found, vec = spectral.eigen(a)
    scale = np.linalg.norm(a) + 1e-300
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * scale
    assert np.linalg.norm(a @ vec - vec * found) <= 1e-13 * scale
    assert np.linalg.norm(vec.T @ vec - np.eye(size)) <= 1e-12


def test_shifts_that_meet_a_value():
    """Cut at the median of its diagonal, a block of this matrix has vectors of both sides mixed."""
    rng = np.random.default_rng(17)
    turn = np.linalg.qr(rng.standard_normal((17, 17)))[0]
    values = np.r_[rng.random(6), np.zeros(11)]
    a = turn @ np.diag(values) @ turn.T
    a = (a + a.T) / 2
    found, vec = spectral.eigen(a)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13
    assert np.linalg.norm(a @ vec - vec * found) <= 1e-13


def test_polar_is_sign():
    """The polar factor of a symmetric matrix has its eigenvectors and the signs of its values."""
    rng = np.random.default_rng(1)
    turn = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    values = np.r_[1e-9, -1e-6, rng.standard_normal(10)]
    assert np.allclose(spectral.polar(turn @ np.diag(values) @ turn.T), turn @ np.diag(np.sign(values)) @ turn.T, atol=1e-6)


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for bits in (4, 20, 21, 40, 46):
        x = rng.integers(-(1 << bits), 1 << bits, (50, 3))
        assert (whitening.products(x).astype(object) == x.astype(object).T @ x.astype(object)).all()
