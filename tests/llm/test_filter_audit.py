"""Filter orders against a walk through every row."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tabrecover.llm import filter_audit

from .cases import odd_rows, prose

SCHEMA = "doc_id long, text string, source string, part string, n string, mask string, cells string"
LABELS = "doc_id long, quality int, toxic int, good string, n string"


def brute(rows, labels):
    """Every count, with each order walked by each row; rows are id, text and source."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = defaultdict(Counter)
    parts = set()
    for i, text, source in rows:
        text, part = text or "", source or ""
        parts.add(part)
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and least[text] < i,
        }
        for order in itertools.permutations("ABCDE"):
            there = True
            for step, f in enumerate(order, 1):
                cell = out[part, "".join(order), step]
                cell["unique_fails"] += [x for x in fails if fails[x]] == [f]
                cell["redundant"] += fails[f] and not there
                if there and fails[f]:
                    there = False
                    cell["removed"] += 1
                    cell["good_lost"] += i is not None and i in good
                    cell["toxic_lost"] += i is not None and i in toxic
                    out[part, f]["shapley"] += 1
                cell["kept"] += there
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {
        (p, "".join(o), s): (*(out[p, "".join(o), s][m] for m in names), out[p, f]["shapley"])
        for p in parts
        for o in itertools.permutations("ABCDE")
        for s, f in enumerate(o, 1)
    }


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    marks = spark.createDataFrame([(*r, "x", "x") for r in labels], LABELS)
    found = filter_audit.audit(docs, marks).collect()
    assert len(found) == len({r[:3] for r in found})
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in found}


def test_against_walk(spark):
    rng = random.Random(5)
    rows = [(i, t, None if i is None else f"s{i % 2}") for i, t in odd_rows()]
    for k in range(60):
        text = prose(700 + k % 25, rng.choice([30, 150, 260]), rng.choice([20, 4000]))
        text = text.upper() if rng.random() < 0.2 else text + " 5%" if rng.random() < 0.2 else text
        rows.append((100 + k, text, rng.choice(["", "s0", "s1", None])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(100, 150), *range(15), 101, 101, None]]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_hot_text_and_id(spark, monkeypatch):
    """A text and an id that a third of the rows share are joined in parts."""
    monkeypatch.setattr("tabrecover.plans.joins.HOT_ROWS", 5)
    rows = [(i, "same text", f"s{i}") for i in range(40)] + [(7, prose(i, 9), "s") for i in range(40)] + [(50 + i, prose(i, 9), "s") for i in range(40)]
    labels = [(7, 1, 0), (7, 0, 1), (3, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_empty(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    assert audited(spark, [(1, "x", "s")], []) == brute([(1, "x", "s")], [])


def test_own_filters(spark):
    """Any conditions on texts, here two and the repeat filter: six orders of three steps."""
    docs = spark.createDataFrame([(1, "a b", "s"), (2, "a b", "s"), (3, "c", "s")], "doc_id long, text string, source string")
    own = {"L": lambda text, words: F.length(text) > 2, "W": lambda text, words: F.size(words) > 1}
    found = filter_audit.audit(docs, spark.createDataFrame([], LABELS), own, "R")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in found.collect()}
    assert len(rows) == 18
    assert rows["RLW", 1] == (2, 1, 0) and rows["RLW", 2] == (1, 1, 1) and rows["RLW", 3] == (1, 0, 2)
