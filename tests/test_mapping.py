"""Mapping, decisions and suggestions against plain restatements."""

from __future__ import annotations

import random
import shutil

import pytest
from pyspark.sql import functions as F

from tabrecover.operators import decisions as D
from tabrecover.operators import mapping as M
from tabrecover.operators import suggest as S
from tabrecover.plans import joins
from tabrecover.streaming.decision_state import keep_decisions
from tabrecover.streaming.decisions import LOG_SCHEMA, current_states, follow_decisions

MAPPING = "ord int, scanned string, target string, is_ignored boolean"


def random_log(seed: int, headers: int = 200) -> list[tuple]:
    rng = random.Random(seed)
    log = []
    for h in range(headers):
        for seq in rng.sample(range(100), rng.randint(0, 6)):
            is_map = rng.random() < 0.4
            log.append((f"h{h}", seq, D.MAP if is_map else D.TOGGLE_IGNORE, f"t{seq}" if is_map else None))
    return log


def replay(log: list[tuple]) -> dict[str, tuple]:
    """The log step by step, one header at a time."""
    states: dict[str, tuple] = {}
    for scanned, _, action, target in sorted(log, key=lambda e: e[1]):
        if action == D.MAP:
            states[scanned] = (M.MAPPED, target)
        elif states.get(scanned, ("", None))[0] == M.IGNORED:
            states[scanned] = (D.UNDECIDED, None)
        else:
            states[scanned] = (M.IGNORED, None)
    return states


def states_of(df) -> dict[str, tuple]:
    return {r.scanned: (r.state, r.target) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_fold(spark, seed):
    log = random_log(seed)
    assert states_of(D.fold_decisions(spark.createDataFrame(log, LOG_SCHEMA))) == replay(log)


def test_fold_of_one_hot_header(spark, monkeypatch):
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    log = [("hot", i, D.MAP if i == 500 else D.TOGGLE_IGNORE, "t" if i == 500 else None) for i in range(2000)]
    log += [("cold", 1, D.MAP, "x")]
    assert states_of(D.fold_decisions(spark.createDataFrame(log, LOG_SCHEMA))) == replay(log)


def test_stream_equals_batch(spark, tmp_path):
    log = random_log(7)
    random.Random(1).shuffle(log)
    source = tmp_path / "in"
    source.mkdir()
    for part in range(3):
        rows = spark.createDataFrame(log[part::3], LOG_SCHEMA)
        rows.coalesce(1).write.parquet(str(source / f"p{part}"))
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    writer = follow_decisions(stream, str(tmp_path / "out"))
    run = writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert states_of(current_states(spark, str(tmp_path / "out"))) == replay(log)


@pytest.mark.parametrize("order", ["arrival", "backwards", "mixed"])
def test_state_of_a_stream(spark, tmp_path, order):
    """Many small batches, late ones too, give the fold of the whole log, and a batch reads its own rows only."""
    log = random_log(11, 40) + [("hot", i, D.MAP if i in (500, 90) else D.TOGGLE_IGNORE, f"t{i}" if i in (500, 90) else None) for i in range(1001)]
    log.append(("twice", 1, D.TOGGLE_IGNORE, None))
    rows = sorted(log, key=lambda e: e[1], reverse=order == "backwards")
    if order == "mixed":
        random.Random(2).shuffle(rows)
    for n in range(6):
        part = spark.createDataFrame(rows[n::6] if order == "mixed" else rows[n * 200 : n * 200 + 200 if n < 5 else None], LOG_SCHEMA)
        part.coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
        for file in (tmp_path / f"in{n}").glob("part-*"):
            (tmp_path / "in").mkdir(exist_ok=True)
            shutil.copy(file, tmp_path / "in" / f"{n}.parquet")
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    run = keep_decisions(stream, str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
    run = run.trigger(availableNow=True).start()
    run.awaitTermination(300)
    assert run.exception() is None
    assert states_of(current_states(spark, str(tmp_path / "out"))) == replay(log)
    assert [p["numInputRows"] for p in run.recentProgress if p["numInputRows"]] and sum(p["numInputRows"] for p in run.recentProgress) == len(log)


def test_normalize(spark):
    entries = [
        (0, "a", "x", False), (1, "a", "y", None), (2, "b", "x", False), (3, "b", "", True),
        (4, "c", "", False), (5, "d", None, None), (6, "e", "z", True), (7, "f", "x", False), (8, "f", "", False),
    ]
    found = M.normalize_mapping(spark.createDataFrame(entries, MAPPING))
    assert {tuple(r) for r in found.collect()} == {("a", "y", False), ("b", None, True), ("e", None, True), ("f", "x", False)}


def test_unmapped_keeps_order_and_copies(spark):
    lines = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "c")], "pos int, header string")
    mapping = spark.createDataFrame([(0, "a", "x", False), (1, "z", "", True)], MAPPING)
    assert [r.header for r in M.unmapped_headers(lines, mapping).orderBy("pos").collect()] == ["b", "c", "c"]
    assert tuple(M.unmapped_counts(lines, mapping).first()) == (5, 2, 3)


def test_append_targets(spark):
    old = spark.createDataFrame([(0, "ID"), (1, "Name"), (2, "ID")], "pos int, target string")
    new = spark.createDataFrame([(1, " Name "), (2, "B"), (3, "A"), (4, "B"), (5, None), (6, " ")], "col int, text string")
    found = M.append_targets(old, new).orderBy("part", "pos").collect()
    assert [r.target for r in found] == ["ID", "Name", "ID", "B", "A"]


def test_review_worklist(spark):
    lines = spark.createDataFrame([(i, f"h{i}") for i in (0, 2, 3, 5, 9)], "pos int, header string")
    assert [r.pos for r in D.review_worklist(lines, 3).collect()] == [5, 9, 0, 2]


@pytest.mark.parametrize(("count", "batches"), [(100, {0: 100}), (101, {0: 50, 1: 50, 2: 1})])
def test_batches(spark, count, batches):
    headers = spark.createDataFrame([(f"h{i:04}",) for i in range(count)], "header string").repartition(3)
    numbered = S.suggestion_batches(headers)
    assert [r.header for r in numbered.orderBy("pos").collect()] == [f"h{i:04}" for i in range(count)]
    assert {r.batch: r.n for r in numbered.groupBy("batch").agg(F.count("*").alias("n")).collect()} == batches
    targets = spark.createDataFrame([("T",)], "target string")
    requests = S.batch_requests(numbered, targets).orderBy("batch").collect()
    assert [r.headers for r in requests] == list(batches.values())
    assert requests[0].request.count("\n- h") == batches[0] and requests[0].request.endswith("- T")


def test_parse_and_apply(spark):
    replies = [
        (0, "ScannedColumn|TargetColumn|Confidence\n\n a | T1 | 0.9 \nb|T2\nc|T3|x|y\nd|NO_MATCH|0.99\ne|T1|0.59"),
        (1, "f||0.7\na|T9|95%\ng|T1|\nh|T1|0.6 sure"),
    ]
    parsed = S.parse_suggestions(spark.createDataFrame(replies, "reply int, text string"))
    assert {(r.scanned, r.target, r.confidence) for r in parsed.collect()} == {
        ("a", "T1", 0.9), ("d", "NO_MATCH", 0.99), ("e", "T1", 0.59),
        ("f", "", 0.7), ("a", "T9", 95.0), ("g", "T1", 0.0), ("h", "T1", 0.6),
    }
    accepted = S.accept_suggestions(parsed)
    normalized = M.normalize_mapping(spark.createDataFrame([(0, "h", "", True)], MAPPING))
    targets = spark.createDataFrame([("T1",), ("T2",)], "target string")
    applied = S.apply_suggestions(accepted, normalized, targets)
    assert {tuple(r) for r in applied.collect()} == {("a", "T9", 95.0, False), ("f", "", 0.7, False)}
    sent = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, header string")
    audit = {tuple(r) for r in S.suggestion_audit(sent, accepted).collect()}
    assert audit == {(0, "a", "suggested", "T9", 95.0), (1, "b", "no match", None, None)}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("least", [0.3, 0.6, 0.85])
def test_edit_pairs_are_those_of_all_pairs(spark, least):
    """Short texts over a small alphabet, so that many pairs lie around the bound."""
    rng = random.Random(int(least * 100))
    texts = sorted({"".join(rng.choices("abc", k=rng.randint(1, 13))) for _ in range(90)})
    left, right = texts[::2], texts[1::2]
    found = S.edit_pairs(
        spark.createDataFrame([(t,) for t in left], "a string"), spark.createDataFrame([(t,) for t in right], "b string"), least
    )
    want = {(a, b): 1 - edits(a, b) / max(len(a), len(b)) for a in left for b in right}
    assert {(r.a, r.b): r.score for r in found.collect()} == pytest.approx({p: s for p, s in want.items() if s >= least - 1e-12})


@pytest.mark.parametrize("threshold", [0.4, 0.6, 1.0])
def test_similar_finds_what_all_pairs_find(spark, threshold):
    rng = random.Random(5)
    vocabulary = ["name", "customer", "id", "order", "date", "no", "qty", "prce", "price", "Straße"]

    def names(count):
        return sorted({rng.choice([" ", "_", "--"]).join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(count)})

    headers, targets = [*names(60), "***", "Name", "custName"], names(25)

    def tokens(name):
        spaced = "".join(f" {c}" if c.isupper() and i and name[i - 1].islower() else c for i, c in enumerate(name))
        return "".join(c if c.isalnum() else " " for c in spaced.lower()).split()

    def score(header, target):
        a, b = tokens(header), tokens(target)
        if not a or not b:
            return 0.0
        one, two = " ".join(a), " ".join(b)
        overlap = len({*a} & {*b}) / len({*a} | {*b})
        return max(overlap, 1 - edits(one, two) / max(len(one), len(two)))

    want = {}
    for header in headers:
        scored = [(-score(header, target), target) for target in targets]
        best = min((s for s in scored if -s[0] >= threshold), default=None)
        if best:
            want[header] = (best[1], -best[0])
    found = S.suggest_similar(
        spark.createDataFrame([(h,) for h in headers], "header string"),
        spark.createDataFrame([(t,) for t in targets], "target string"),
        threshold,
    )
    assert {r.scanned: (r.target, r.confidence) for r in found.collect()} == want and len(want) > 3


def test_scorer_hook(spark):
    """A user's function sees candidates only, is loaded once in a task, and its best score wins."""
    headers = ["cust name", "CustName", "order_date", "zzz", "***", "nam cust"]
    targets = ["customer name", "cust name", "Cust-Name", "order date", "price", "name cust"]

    def load():
        import pandas as pd

        state = {"batches": 0}

        def model(names, wanted):
            state["batches"] += 1
            # The score falls with the batch within its load; a null for one target.
            return pd.Series([None if t == "price" else 1 - state["batches"] / 1e6 for t in wanted])

        return model

    h = spark.createDataFrame([(x,) for x in headers], "header string")
    t = spark.createDataFrame([(x,) for x in targets], "target string")
    pairs = {(r.scanned, r.target) for r in S.candidate_pairs(h, t, 0.6).collect()}

    def parts(name):
        spaced = "".join(f" {c}" if c.isupper() and i and name[i - 1].islower() else c for i, c in enumerate(name))
        return "".join(c if c.isalnum() else " " for c in spaced.lower()).split()

    want = set()
    for a in headers:
        for b in targets:
            x, y = parts(a), parts(b)
            if x and y:
                one, two = " ".join(x), " ".join(y)
                overlap = len({*x} & {*y}) / len({*x} | {*y})
                if max(overlap, 1 - edits(one, two) / max(len(one), len(two))) >= 0.6:
                    want.add((a, b))
    assert pairs == want and 5 < len(want) < len(headers) * len(targets)
    found = {r.scanned: (r.target, r.confidence) for r in S.suggest_scored(h, t, load, candidates=0.6).collect()}
    assert set(found) == {a for a, b in want if b != "price"}
    assert all(target == min(b for a, b in want if a == scanned and b != "price") for scanned, (target, _) in found.items())
    assert all(confidence > 1 - 1e-4 for _, confidence in found.values())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how, monkeypatch):
    large = spark.createDataFrame([(i, f"k{i % 7 if i % 3 else 0}") for i in range(500)], "i int, k string")
    lookup = spark.createDataFrame([(f"k{i}", i) for i in range(0, 9, 2)], "k string, v int")
    want = sorted(map(str, large.join(lookup, ["k"], how).collect()))
    assert sorted(map(str, joins.salted_join(large, lookup, ["k"], how).collect())) == want
    monkeypatch.setattr(joins, "HOT_ROWS", 60)
    assert joins.key_counts(large, ["k"]).filter("n > 60").count() == 1
    assert sorted(map(str, joins.salted_join(large, lookup, ["k"], how).collect())) == want
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    assert sorted(map(str, joins.lookup_join(large, lookup, ["k"], how).collect())) == want


def test_broadcast_is_measured(spark):
    lookup = spark.range(1000).withColumn("text", F.repeat(F.lit("x"), 100))
    assert joins.fits_broadcast(lookup)
    assert not joins.fits_broadcast(lookup, max_rows=999)
    assert not joins.fits_broadcast(lookup, max_bytes=100_000)


def test_fan_in_and_coverage(spark):
    entries = [(0, "a", "x", False), (1, "b", "x", False), (2, "c", "", True), (3, "d", "y", False)]
    normalized = M.normalize_mapping(spark.createDataFrame(entries, MAPPING))
    targets = spark.createDataFrame([("x",), ("z",)], "target string")
    assert {tuple(r) for r in M.mapping_fan_in(normalized, targets).collect()} == {("x", 2, "a", "b"), ("z", 0, None, None)}
    pairs = "scanned string, target string"
    merged = M.merge_mapping(
        normalized,
        spark.createDataFrame([("e", "e"), ("a", "a")], pairs),
        spark.createDataFrame([("e", "x"), ("f", "y"), ("c", "y")], pairs),
    )
    assert states_of(merged) == {
        "a": ("mapped", "x"), "b": ("mapped", "x"), "c": ("ignored", None), "d": ("mapped", "y"),
        "e": ("mapped", "e"), "f": ("suggested", "y"),
    }
    lines = spark.createDataFrame([(i, h) for i, h in enumerate("abcdefgg")], "pos int, header string")
    assert M.mapping_coverage(lines, merged).first().asDict() == {
        "total": 8, "mapped": 4, "suggested": 1, "ignored": 1, "unmapped": 2
    }


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_of_keys_alone(spark, how, monkeypatch):
    """Rows that are nothing but their key, a hot one among them, keep their number."""
    monkeypatch.setattr(joins, "HOT_ROWS", 60)
    large = spark.createDataFrame([(f"k{i % 7 if i % 3 else 0}",) for i in range(500)] + [(None,)] * 3, "k string")
    lookup = spark.createDataFrame([(f"k{i}", i) for i in (0, 0, 2, 4, 6, 8)], "k string, v int")
    want = sorted(map(str, large.join(lookup, ["k"], how).collect()))
    assert sorted(map(str, joins.salted_join(large, lookup, ["k"], how).collect())) == want
