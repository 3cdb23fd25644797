"""Outputs that count all at once, and output names no two sheets share."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tabrecover import jobs
from tabrecover.operators import reports as R
from tabrecover.operators.formatting import Layout
from tabrecover.sinks import publish as P
from tabrecover.sinks import writers as W
from tabrecover.sources.lists import read_mapping
from workload.xlsx import Cell, workbook


def rows(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v bigint")


def write(spark, *values):
    def job(folder):
        rows(spark, *values).write.parquet(f"{folder}/numbers")
        W.write_report(rows(spark, len(values)), f"{folder}/count")

    return job


def found(spark, path):
    numbers = sorted((r.run, r.v) for r in P.published(spark, path, "numbers", "v bigint").collect())
    counts = {r.run: r.v for r in P.published(spark, path, "count", "v bigint", "csv").collect()}
    return numbers, counts


def test_a_run_replaces_its_own(spark, tmp_path):
    path = str(tmp_path)
    assert found(spark, path) == ([], {}) and P.published_folder(spark, path, "a") is None
    first = P.publish(spark, path, "a", write(spark, 1, 2))
    P.publish(spark, path, "b", write(spark, 7))
    P.publish(spark, path, "a", write(spark, 3))
    assert found(spark, path) == ([("a", 3), ("b", 7)], {"a": 1, "b": 1})
    assert P.published_folder(spark, path, "a") != first
    assert {(r.run, r.version) for r in P.manifest(spark, path).collect()} == {("a", 2), ("b", 1)}


def test_a_lost_attempt_changes_nothing(spark, tmp_path):
    path = str(tmp_path)

    def lost(folder):
        rows(spark, 100).write.parquet(f"{folder}/numbers")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        P.publish(spark, path, "a", lost)
    assert found(spark, path) == ([], {})
    P.publish(spark, path, "a", write(spark, 1))
    with pytest.raises(RuntimeError, match="lost"):
        P.publish(spark, path, "a", lost)
    assert found(spark, path) == ([("a", 1)], {"a": 1})


def test_readers_keep_the_rows_they_began_with(spark, tmp_path):
    path = str(tmp_path)
    P.publish(spark, path, "a", write(spark, 1))
    before = P.published(spark, path, "numbers", "v bigint")
    P.publish(spark, path, "a", write(spark, 2))
    assert [r.v for r in before.collect()] == [1]


@pytest.mark.parametrize("run", ["", "a/b", "..=", "a b", "é"])
def test_names_of_runs(spark, tmp_path, run):
    with pytest.raises(ValueError, match="not a name"):
        P.publish(spark, str(tmp_path), run, write(spark, 1))


def test_runs_that_look_like_numbers(spark, tmp_path):
    path = str(tmp_path)
    for run in ("2024-05", "007", "7"):
        P.publish(spark, path, run, write(spark, 1))
    assert found(spark, path)[0] == [("007", 1), ("2024-05", 1), ("7", 1)]


def test_unique_names(spark):
    sheets = [("x/a.xlsx", "S"), ("y/a.xlsx", "S"), ("y/A.xlsx", "s"), ("y/b.xlsx", "S"), ("y/" + "c" * 200 + ".xlsx", "S"), ("z/.xlsx", "S"), ("y/é.xlsx", "a/b:c")]
    named = {(r.file, r.sheet): r.output for r in R.unique_names(spark.createDataFrame(sheets, "file string, sheet string")).collect()}
    assert len(named) == len(sheets) == len({n.lower() for n in named.values()})
    assert named["y/b.xlsx", "S"] == "b-S" and named["y/é.xlsx", "a/b:c"] == "é-a/b:c"
    assert all(named[s].lower().startswith("a-s-") and len(named[s]) == 36 for s in sheets[:3])
    assert max(map(len, named.values())) < 70


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_named_sheets_with_a_target_called_output(spark, tmp_path, fmt):
    values = [("x/a.xlsx", "S", n, f"t{n}") for n in range(2, 8)] + [("x/b.xlsx", "S 1", 2, "u")]
    formatted = spark.createDataFrame(values, "file string, sheet string, target_row bigint, Output string")
    names = R.unique_names(formatted.select("file", "sheet").distinct())
    W.write_named_sheets(formatted, names, str(tmp_path / "out"), fmt, row_block=2)
    assert {f for f in os.listdir(tmp_path / "out") if "=" in f} == {"output_=a-S", "output_=b-S 1"}
    back = W.read_sheets(spark, str(tmp_path / "out"), formatted.schema, fmt)
    assert sorted(map(tuple, back.collect())) == sorted(values)


def test_format_job_twice(spark, tmp_path):
    """The job run again under its name leaves one set of rows in every table, and sheets by their names."""
    (tmp_path / "in" / "deep").mkdir(parents=True)
    sheet = {1: {1: Cell("s", "Part"), 2: Cell("s", "Qty")}, 2: {1: Cell("n", 1), 2: Cell("n", 2)}, 3: {1: Cell("n", 3), 2: Cell("n", 4)}}
    for name in ("in/a.xlsx", "in/b.xlsx", "in/deep/a.xlsx"):
        (tmp_path / name).write_bytes(workbook([("S 1", sheet)]))
    entries = '{"mappings": [{"scanned_column": "Part", "target_column": "part", "is_ignored": false}]}'
    (tmp_path / "mapping.json").write_text(entries)
    decoded = jobs.ingest(spark, [str(tmp_path / "in")], str(tmp_path / "grid"), partitions=2, in_pieces=True)
    mapping, layout, path = read_mapping(spark, str(tmp_path / "mapping.json")), Layout(("part",)), str(tmp_path / "out")
    for _ in range(2):
        P.publish(spark, path, "may", lambda folder: jobs.format_all(decoded, mapping, layout, folder, jobs.Settings(named=True)))
    folder = P.published_folder(spark, path, "may")
    assert spark.read.parquet(f"{folder}/sheets").count() == 6
    names = {f.removeprefix("output=") for f in os.listdir(f"{folder}/sheets") if "=" in f}
    assert "b-S 1" in names and len(names) == 3 and sum(n.startswith("a-S 1-") for n in names) == 2
    schema = "file string, sheet string, columns_processed bigint"
    summary = P.published(spark, path, "summary", schema)
    assert summary.count() == 3 and {r.run for r in summary.collect()} == {"may"}
    assert summary.select(F.sum("columns_processed")).first()[0] == 3
