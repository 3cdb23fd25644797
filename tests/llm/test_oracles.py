"""Numbered queries against their SQL twins on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

from conftest import SF
from tabrecover.llm.oracles import ORACLES
from tabrecover.llm.queries import QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
import check  # noqa: E402


@pytest.mark.parametrize("name", ORACLES)
def test_twin(spark, name):
    frame = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    answer = check.connect(SF).sql(ORACLES[name])
    assert {c: check.SAME_TYPE.get(t, t) for c, t in frame.dtypes} == dict(zip(answer.columns, map(str, answer.types), strict=True))
    assert check.normal(frame.columns, rows) == check.normal(answer.columns, answer.fetchall())
