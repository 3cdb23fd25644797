"""Lists, mappings, tables and writers, each written to a fresh folder and read back."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tabrecover.grid import GRID_SCHEMA
from tabrecover.operators import bounds as B
from tabrecover.operators import headers as H
from tabrecover.operators import mapping as M
from tabrecover.operators import reports as R
from tabrecover.operators import types as T
from tabrecover.operators.formatting import Layout
from tabrecover.plans.positions import with_position
from tabrecover.sinks import writers as W
from tabrecover.sources import lists as L
from tabrecover.sources.tables import table_to_grid


def test_line_list(spark, tmp_path):
    (tmp_path / "list").write_text(" b \n\na\n\t\nb\n　c　\n", encoding="utf-8")
    lines = L.read_lines(spark, str(tmp_path / "list")).orderBy("pos").collect()
    assert [(r.pos, r.header) for r in lines] == [(0, "b"), (1, "a"), (2, "b"), (3, "c")]


def test_targets(spark, tmp_path):
    missing = L.read_targets(spark, str(tmp_path / "none")).orderBy("pos").collect()
    assert [r.target for r in missing] == list(L.DEFAULT_TARGETS) and len(missing) == 8
    (tmp_path / "own").write_text("X\n")
    assert [r.target for r in L.read_targets(spark, str(tmp_path / "own")).collect()] == ["X"]
    (tmp_path / "empty").write_text("\n \n")
    with pytest.raises(ValueError, match="no target columns"):
        L.read_targets(spark, str(tmp_path / "empty"))


@pytest.mark.parametrize("n", [0, 1, 35, 25_000])
def test_mapping_round_trip(spark, tmp_path, n):
    entries = [(f"h{i}\n,]", f'T"{i}' if i % 3 else "", i % 3 == 0) for i in range(n)]
    df = spark.createDataFrame(entries, "scanned string, target string, is_ignored boolean")
    W.write_mapping(df.repartition(5), str(tmp_path / "mapping"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "mapping").glob("part-*")))
    document = json.loads(whole)["mappings"]
    assert [e["scanned_column"] for e in document] == sorted(e[0] for e in entries)
    back = L.read_mapping(spark, str(tmp_path / "mapping")).orderBy("ord").collect()
    assert [(r.scanned, r.target, r.is_ignored) for r in back] == sorted(entries)
    assert [r.ord for r in back] == list(range(n))
    (tmp_path / "one.json").write_text(json.dumps({"mappings": document}, indent=1))
    again = L.read_mapping(spark, str(tmp_path / "one.json")).collect()
    assert sorted((r.scanned, r.target, r.is_ignored) for r in again) == sorted(entries)


def test_later_documents_win(spark, tmp_path):
    def document(target):
        return json.dumps({"mappings": [{"scanned_column": "a", "target_column": target}]})

    for order in (("x", "y"), ("y", "x")):
        folder = tmp_path / order[0]
        folder.mkdir()
        for k, target in enumerate(order):
            (folder / f"{k}.json").write_text(document(target))
        found = M.normalize_mapping(L.read_mapping(spark, str(folder))).collect()
        assert [(r.scanned, r.target) for r in found] == [("a", order[1])]
    texts = spark.createDataFrame([(2, document("p")), (1, document("q"))], "n long, text string")
    assert M.normalize_mapping(L.mapping_entries(texts, F.col("n"))).first().target == "p"


def test_text_after_a_document_is_an_error(spark, tmp_path):
    one = '{"mappings": [{"scanned_column": "a", "target_column": "b"}]}'
    for k, rest in enumerate((one, "x", "]")):
        (tmp_path / f"{k}.json").write_text(f"{one}\n{rest}")
        with pytest.raises(Exception, match="(?i)malformed"):
            L.read_mapping(spark, str(tmp_path / f"{k}.json")).collect()
    (tmp_path / "cut.json").write_text('{"mappings":[\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        L.read_mapping(spark, str(tmp_path / "cut.json")).collect()


def test_broken_mapping_is_an_error(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"mappings": [')
    with pytest.raises(Exception, match="(?i)malformed"):
        L.read_mapping(spark, str(tmp_path / "bad.json")).collect()


def test_header_list_is_sorted_over_its_files(spark, tmp_path):
    names = [f"h{i * 7919 % 1000:03}" for i in range(1000)]
    W.write_lines(spark.createDataFrame([(n,) for n in names], "header string").repartition(4), str(tmp_path / "l"))
    parts = sorted((tmp_path / "l").glob("part-*"))
    assert [line for p in parts for line in p.read_text().splitlines()] == sorted(names)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
@pytest.mark.parametrize("folders", [True, False])
def test_sheets_round_trip(spark, tmp_path, fmt, folders):
    rows = [(f"d{i % 2}/a b.xlsx", f"{i % 3}", i, f" v,\"{i}\"\n\\", None) for i in range(30)]
    df = spark.createDataFrame(rows, "file string, sheet string, target_row bigint, x string, `y.z` string")
    W.write_sheets(df, str(tmp_path / "out"), fmt, folder_per_sheet=folders, row_block=8)
    back = W.read_sheets(spark, str(tmp_path / "out"), df.schema, fmt)
    assert sorted(tuple(r[c] for c in ("file", "sheet", "target_row", "x", "y.z")) for r in back.collect()) == sorted(rows)


def test_stats_are_appended(spark, tmp_path):
    stats = spark.range(3).toDF("n")
    W.append_stats(stats, str(tmp_path / "s"), "one")
    W.append_stats(stats, str(tmp_path / "s"), "two")
    W.append_stats(stats, str(tmp_path / "s"), "one")  # again, after a failure
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("run").count().orderBy("run").collect() == [("one", 3), ("two", 3)]


def test_positions_over_many_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(7)
    found = with_position(df, ["k"])
    assert found.filter("pos <> k").count() == 0 and found.count() == 5000


def test_table_as_sheet(spark):
    df = spark.createDataFrame([(3, "c", None), (1, "a", True), (2, " ", False)], "k int, t string, b boolean")
    grid = table_to_grid(df, F.lit("f"), F.lit("s"), ["k", "t", "b"], order=["k"])
    rows = {r.row: [(c.value, c.dtype) if c else None for c in r.cells] for r in grid.collect()}
    assert rows == {
        1: [("k", "s"), ("t", "s"), ("b", "s")],
        2: [("1", "n"), ("a", "s"), ("true", "b")],
        3: [("2", "n"), (" ", "s"), ("false", "b")],
        4: [("3", "n"), ("c", "s"), None],
    }
    assert B.sheet_bounds(grid).first().header_row == 1


def test_provenance_follows_the_walk(spark):
    def sheet(file, idx, *texts):
        return (file, idx, f"s{idx}", 1, [(t, "s", "General") for t in texts])

    grid = spark.createDataFrame(
        [sheet("in/a.xlsx", 0, "X", " Y"), sheet("in/a/z.xlsx", 0, "<i>X</i>", "Z"), sheet("in/a/z.xlsx", 1, "Y", "X ")],
        GRID_SCHEMA,
    )
    headers = H.clean_headers(H.sheet_headers(grid, B.sheet_bounds(grid)))
    found = H.header_provenance(headers)
    # the folder "a" is walked before the file "a.xlsx"; outer spaces are no change
    assert {r.header: (r.first_file, r.first_sheet, r.first_col, r.first_original, r.occurrences) for r in found.collect()} == {
        "X": ("in/a/z.xlsx", "s0", 1, "<i>X</i>", 3),
        "Y": ("in/a/z.xlsx", "s1", 1, None, 2),
        "Z": ("in/a/z.xlsx", "s0", 2, None, 1),
    }
    marked = H.mark_first_seen(headers, found)
    assert marked.filter("is_new").count() == 3 and marked.filter("not is_new").count() == 3


def test_file_statistics_count_broken_files(spark):
    stats = spark.createDataFrame(
        [("a", "s1", 2, 1), ("a", "s2", 0, 0)], "file string, sheet string, headers_found bigint, empty_headers bigint"
    )
    rejects = spark.createDataFrame([("a", "s3", "x"), ("b", None, "y")], "file string, sheet string, reason string")
    found = H.file_scan_stats(stats, rejects)
    assert {tuple(r) for r in found.collect()} == {("a", 2, 1, 2, 1, False), ("b", 0, 0, 0, 0, True)}
    total = H.total_scan_stats(found, spark.createDataFrame([("h", None), ("g", "G")], "header string, first_original string"))
    assert total.first().asDict() == {
        "files_processed": 2, "files_with_errors": 1, "sheets_processed": 2, "sheets_with_errors": 1,
        "headers_found": 2, "empty_headers": 1, "headers_cleaned": 1, "unique_headers": 2,
    }
    status = R.batch_summary(stats.select("file"), rejects)
    assert {tuple(r) for r in status.collect()} == {("error", 2)}


def test_types_hold_every_value(spark):
    columns = {
        "time": [("12:30:00", "d"), ("2024-01-01 00:00:00", "d")],
        "large": [("9007199254740993", "n"), ("-5", "n")],
        "mixed": [("9007199254740993", "n"), ("0.5", "n")],
        "real": [("3", "n"), ("0.1", "n")],
        "longer": [("123456789012345678901", "n"), ("1", "n")],
        "coded": [("007", "n"), ("8", "n")],
        "truth": [("TRUE", "b"), ("FALSE", "b")],
        "error": [("x", "n"), ("1", "n")],
    }
    layout = Layout(tuple(columns))
    rows = [("f", "s", k, [(*v[k], "General") for v in columns.values()]) for k in (0, 1)]
    picked = "array<struct<value:string,dtype:string,number_format:string>>"
    cells = spark.createDataFrame(rows, f"file string, sheet string, target_row bigint, picked {picked}")
    types = T.column_types(T.column_formats(T.column_profile(cells, layout)))
    assert types == {
        "time": "string", "large": "bigint", "mixed": "string", "real": "double", "longer": "string",
        "coded": "string", "truth": "boolean", "error": "string",
    }
    text = cells.select("file", "sheet", "target_row", *[F.col("picked.value")[i].alias(c) for i, c in enumerate(columns)])
    typed = T.typed_rows(text, types).orderBy("target_row").collect()
    assert typed[0].large == 9007199254740993 and typed[1].real == 0.1
    assert all(v is not None for r in typed for v in r)


def test_types(spark):
    layout = Layout(("n", "d", "b", "mixed", "empty"))
    kinds = [("1.5", "n", "0.00"), ("2024-01-02 03:04:05", "d", "yyyy"), ("TRUE", "b", "General"), ("7", "n", "0"), None]
    other = [("=A1", "s", "@"), (" ", "s", "@"), ("FALSE", "b", "General"), ("x", "s", "@"), None]
    picked = "array<struct<value:string,dtype:string,number_format:string>>"
    df = spark.createDataFrame([("f", "s", 2, kinds), ("f", "s", 3, other)], f"file string, sheet string, target_row bigint, picked {picked}")
    formats = T.column_formats(T.column_profile(df, layout))
    assert {tuple(r) for r in formats.collect()} == {
        ("n", "double", "0.00", 1), ("d", "timestamp_ntz", "yyyy", 1), ("b", "boolean", None, 2), ("mixed", "string", "0", 2),
    }
    text = spark.createDataFrame(
        [("f", "s", 2, "1.5", "2024-01-02 03:04:05", "TRUE", "7", None), ("f", "s", 3, None, " ", "FALSE", "x", None)],
        "file string, sheet string, target_row bigint, n string, d string, b string, mixed string, empty string",
    )
    typed = T.typed_rows(text, T.column_types(formats))
    assert [t for _, t in typed.dtypes][3:] == ["double", "timestamp_ntz", "boolean", "string", "string"]
    assert [tuple(r)[3:] for r in typed.orderBy("target_row").collect()][1] == (None, None, False, "x", None)


DECIMALS = {
    "real": ["1.5", "12.500", "0.1", "-3", "9007199254740992"],
    "power": ["1.5E10", "2", "1e-07"],
    "exact": ["12345678901234567.89", "0.50", "-9007199254740993.00", "1.25"],
    "fine": ["0.1234567890123456789012"],
    "scales": ["12345678901234567.89", "0.5"],
    "wide": ["1234567890123456789012345678.50000000000"],
    "mixed": ["12345678901234567.89", "1E5"],
    "lost": ["1e400", "1"],
}


def test_numbers_keep_every_digit(spark):
    """A column is double only if doubles hold its numbers, else decimal, else text; cast back, no number differs."""
    from decimal import Decimal

    rows = [[(values[i] if i < len(values) else None, "n", "0") for values in DECIMALS.values()] for i in range(5)]
    cells = spark.createDataFrame([(r,) for r in rows], "picked array<struct<value:string,dtype:string,number_format:string>>")
    layout = Layout(tuple(DECIMALS))
    types = T.column_types(T.column_formats(T.column_profile(cells, layout)))
    assert types == {
        "real": "double", "power": "double", "exact": "decimal(19,2)", "fine": "decimal(22,22)", "scales": "string", "wide": "string", "mixed": "string", "lost": "string",
    }
    text = cells.select(F.lit("f").alias("file"), F.lit("s").alias("sheet"), F.lit(1).alias("target_row"), *[F.col("picked")[i].value.alias(c) for i, c in enumerate(DECIMALS)])
    typed = T.typed_rows(text, types).select(*[F.col(c).cast("string") for c in DECIMALS]).collect()
    for c, values in DECIMALS.items():
        got = [r[c] for r in typed if r[c] is not None]
        assert [Decimal(v) for v in got] == [Decimal(v) for v in values]
        assert got == values or types[c] == "double"


def test_rollup_is_the_three_reports(spark):
    """One aggregate gives what the reports per sheet, per file and in total give, errors included."""
    import random

    rng = random.Random(12)
    sheets = [(f"f{i}", f"s{j}") for i in range(6) for j in range(rng.randint(1, 3))]
    rows = []
    for n, (f, s) in enumerate(sheets):
        for col in range(rng.randint(0, 6)):
            rows.append((f, s, n, 1, col + 1, rng.choice(["id", "name", " name", "<b>", "", None, "qty"]), "s"))
    headers = H.clean_headers(spark.createDataFrame(rows, "file string, sheet string, sheet_idx long, row long, col int, text string, dtype string"))
    bounds = spark.createDataFrame([(f, s, 1) for f, s in sheets], "file string, sheet string, header_row long")
    rejects = spark.createDataFrame([("f0", "bad", "x"), ("f9", None, "y"), ("f8", "only", "z")], "file string, sheet string, reason string")
    found = {(r.level, r.file, r.sheet): r for r in H.scan_rollup(bounds, headers, rejects).collect()}
    per_sheet = H.sheet_scan_stats(bounds, headers)
    for r in per_sheet.collect():
        got = found.pop(("sheet", r.file, r.sheet))
        assert (got.headers_found, got.empty_headers, got.cleaned_headers) == (r.headers_found, r.empty_headers, r.cleaned_headers)
    per_file = H.file_scan_stats(per_sheet, rejects)
    for r in per_file.collect():
        got = found.pop(("file", r.file, None))
        assert (got.sheets_processed, got.sheets_with_errors, got.headers_found, got.empty_headers, got.files_with_errors == 1) == tuple(r[1:])
    total = H.total_scan_stats(per_file, H.header_provenance(headers)).first().asDict()
    got = found.pop(("total", None, None)).asDict()
    assert {k: got[k] for k in total if k != "headers_cleaned"} == {k: v for k, v in total.items() if k != "headers_cleaned"}
    assert {k[0] for k in found} == {"sheet"} and {k[2] for k in found} == {"bad", "only"}
    none = H.scan_rollup(bounds.filter("false"), headers.filter("false"), rejects.filter("false")).collect()
    assert [(r.level, r.files_processed, r.unique_headers) for r in none] in ([], [("total", 0, 0)])
