"""Nearest neighbours against all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabrecover.llm import block_search

SCHEMA = "vec_id long, embedding array<double>, label int, tile string, n string, vector string, side string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, k, every=50):
    """Sorted results of every query row: score, id (null ids last)."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(fine):
        if i is None or i % every:
            continue
        found = []
        for b, (j, w) in enumerate(fine):
            if a != b and len(v) == len(w):
                dot = sum(x * y for x, y in zip(v, w, strict=True))
                size = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))
                found.append((-dot / size, j is None, j or 0, j))
        out += [(i, n + 1, r[3], -r[0]) for n, r in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def searched(spark, rows, k=5, parts=3):
    packed = block_search.tiles(vectors(spark, rows).repartition(parts))
    found = block_search.search(packed, block_search.is_query(50), k)
    return sorted((tuple(r) for r in found.collect()), key=str)


def gauss(rng, size):
    return [rng.gauss(0, 1) for _ in range(size)]


def odd(rng):
    same = gauss(rng, 8)
    rows = [(i, gauss(rng, 8)) for i in range(260)]
    rows += [(1000 + i, same) for i in range(90)]  # a third of the rows is one vector
    rows += [(1100, [2 * c for c in same]), (1100, same), (1150, [-c for c in same])]  # repeated id, scaled and opposite
    rows += [(None, same), (None, gauss(rng, 8)), (50, gauss(rng, 8))]
    rows += [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [1.0] * 7 + [None]), (2200, [math.nan] + [1.0] * 7), (2250, [math.inf] + [1.0] * 7)]
    rows += [(3000 + i, gauss(rng, 3)) for i in range(3)] + [(4000, gauss(rng, 11))]  # fewer candidates than k, none at all
    rows += [(5000, [1e-5 * c for c in same]), (5050, [0.0] * 7 + [1.0])]
    return rows


@pytest.mark.parametrize("tile, bucket, groups", [(2048, 16 << 20, 64), (16, 4000, 64), (7, 1 << 20, 2)])
def test_against_all_pairs(spark, monkeypatch, tile, bucket, groups):
    """Whatever the tiles, buckets and groups are."""
    for name, value in (("TILE", tile), ("BUCKET", bucket), ("GROUPS", groups), ("GROUP", 3)):
        monkeypatch.setattr(block_search, name, value)
    rows = odd(random.Random(6))
    got, want = searched(spark, rows), brute(rows, 5)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)
    # Scaled copies tie but for the last bit, all others must agree in their ids as well.
    assert [g[2] for g in got if g[3] < 1 - 1e-12] == [w[2] for w in want if w[3] < 1 - 1e-12]


def test_ties_to_smaller_id(spark):
    same = [1.0, 2.0, 3.0]
    got = searched(spark, [(i, same) for i in [*range(100, 0, -1), None]], k=3)
    assert [g[1:3] for g in got] == [(1, 1), (2, 2), (3, 3)] * 2
    assert len({g[3] for g in got}) == 1


def test_empty_and_alone(spark):
    assert searched(spark, []) == []
    assert searched(spark, [(50, [1.0, 2.0])]) == []
    assert searched(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []


def test_given_table(spark):
    from conftest import SF

    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = searched(spark, rows), brute(rows, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 16, 64]), st.sampled_from([1.0, 1e-3, 30.0]))
def test_bound_holds(seed, size, spread):
    """Codes and left-out lengths bound every cosine."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((30, size)) * np.exp(spread * rng.standard_normal(size) / 10)
    x[5] = x[4]
    codes, steps, left = block_search.coded(x)
    near = (codes.astype(np.float32) @ codes.T.astype(np.float32)).astype(float) * steps[:, None] * steps
    size_of = block_search.lengths(x)
    true = (x @ x.T) / np.outer(size_of, size_of)
    wide = (1 + left[:, None]) * left + left[:, None] + 1e-9
    assert (np.abs(near - true) <= wide).all()


def test_few_are_computed():
    """Bounds leave a few of a hundred pairs."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2048, 64))
    row = {"tile": "a", "size": 64, "ids": list(range(2048)), "places": list(range(2048))}
    codes, steps, left = block_search.coded(x)
    row |= {"codes": codes.tobytes(), "steps": steps.tobytes(), "left": left.tobytes(), "vectors": x.tobytes()}
    tile = block_search.Tile(row)
    bucket = block_search.Bucket([tile], 5)
    bucket.meet(tile)
    assert bucket.computed < 0.01 * 2048 * 2048
