"""Registered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

from conftest import SF

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

QUERIES = entry.QUERIES
SQL = entry.oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    frame = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    assert rows
    if name not in SQL:
        return
    answer = con.sql(SQL[name])
    assert {c: check.SAME_TYPE.get(t, t) for c, t in frame.dtypes} == dict(zip(answer.columns, map(str, answer.types)))
    assert check.normal(frame.columns, rows) == check.normal(answer.columns, answer.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
