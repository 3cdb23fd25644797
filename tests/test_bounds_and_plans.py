"""Random sheets against plain restatements; small blocks so that sheets span several."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tabrecover.grid import CELL_TYPE, GRID_SCHEMA, cells_to_grid, grid_to_cells
from tabrecover.operators import bounds as B
from tabrecover.operators import formatting as Fm
from tabrecover.operators import headers as H
from tabrecover.operators import mapping as M
from tabrecover.operators import reports as R
from tabrecover.plans.blocks import block_of
from tabrecover.plans.checkpoints import SHUFFLE_CLEANUP, stored, stored_in_buckets

LAYOUT = Fm.Layout(("a", "", "b", "a", "c"), header_row=2)
NAMES = ["h0", "h1", "<b>h2</b>", " h3 ", "h4"]


def grid_of(spark, sheets: dict[str, dict[int, list]]):
    rows = [
        ("f", int(name), name, row, [None if v is None else (v, "s", "General") for v in values])
        for name, sheet in sheets.items()
        for row, values in sheet.items()
    ]
    return spark.createDataFrame(rows, GRID_SCHEMA)


def random_sheets(count: int, seed: int, header: bool = False) -> dict[str, dict[int, list]]:
    rng = random.Random(seed)
    sheets = {}
    for i in range(count):
        height = rng.randint(1, 12)
        rows = {
            row: [rng.choice([None, " ", "x", "=z"]) for _ in range(rng.randint(0, 5))]
            for row in range(1, height + 1)
            if rng.random() < 0.85
        }
        if header:
            rows = {row + 1: values for row, values in rows.items()}
            rows[1] = [rng.choice([*NAMES, None]) for _ in range(5)] + ["last"]
        sheets[str(i)] = rows or {1: []}
    return sheets


def filled(value) -> bool:
    return value is not None and value.strip() != ""


def bounds_of(sheet: dict[int, list], tolerance: int) -> tuple:
    places = [(c + 1, r) for r, values in sheet.items() for c, v in enumerate(values) if filled(v)]
    if not places:
        return None, 1, 1
    right = max(c for c, _ in places)
    column = sorted(r for c, r in places if c == right)
    header = column[0]
    for row in column:
        if all(row + k not in column for k in range(1, tolerance + 1)):
            return right, header, row
    return right, header, column[-1]


@pytest.mark.parametrize("tolerance", [0, 1, 2, 3])
@pytest.mark.parametrize("row_block", [2, 5, 1 << 17])
def test_bounds(spark, tolerance, row_block):
    sheets = random_sheets(150, seed=tolerance)
    grid = grid_of(spark, sheets)
    found = B.table_end(grid, B.sheet_bounds(grid), tolerance, row_block=row_block).collect()
    assert len(found) == len(sheets)
    for r in found:
        sheet = sheets[r.sheet]
        assert (r.max_col, r.header_row, r.table_end_row) == bounds_of(sheet, tolerance), sheet
        assert r.max_row == max(sheet)


@pytest.mark.parametrize("tolerance", [0, 1, 3])
@pytest.mark.parametrize("row_block", [2, 4])
def test_bounds_of_a_grid_read_where_it_is(spark, monkeypatch, tolerance, row_block):
    monkeypatch.setattr("tabrecover.operators.bounds.ROW_BLOCK", 8)
    sheets = random_sheets(150, seed=tolerance)
    grid = stored_in_buckets(grid_of(spark, sheets).withColumn("block", block_of(F.col("row"), 8)), ["file", "sheet", "block"], 5)
    monkeypatch.setattr("tabrecover.operators.bounds.blocked", lambda g, size: g if size == 8 else g.withColumn("block", block_of(F.col("row"), size)))
    bounds = stored(B.sheet_bounds(grid))
    ends = B.table_end(grid, bounds, tolerance, row_block=row_block, tasks=7)
    assert {r.sheet: r.table_end_row for r in ends.collect()} == {name: bounds_of(sheet, tolerance)[2] for name, sheet in sheets.items()}
    # Only what is known of blocks is sent on, by sheet; the rows are sent by no block of their own.
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION" in line]


def test_shuffle_files_of_stored_rows_are_removed(spark):
    def files() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    setting, before = spark.conf.get(SHUFFLE_CLEANUP, None), files()
    tables = [stored(spark.range(1000).repartition(7, "id")), stored_in_buckets(spark.range(1000), ["id"], 3)]
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    deadline = time.time() + 30
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before
    assert [t.count() for t in tables] == [1000, 1000]


def test_headers_of_deep_and_empty_sheets(spark):
    sheets = {
        "0": {1: ["title"], 100: ["A", None, "B", "", " "], 101: ["1", None, "2"]},
        "1": {1: ["A", "A"], 2: ["1", "2"]},
        "2": {1: [" ", "\t"]},
        "3": {0: []},
    }
    grid = grid_of(spark, sheets)
    bounds = B.sheet_bounds(grid)
    headers = H.clean_headers(H.sheet_headers(grid, bounds))
    found = sorted((r.sheet, r.row, r.col, r.text, r["class"]) for r in headers.collect() if r.text is not None)
    # the blank text in column 5 comes after the rightmost filled column but is a cell
    assert found == [
        ("0", 100, 1, "A", "as_is"), ("0", 100, 3, "B", "as_is"), ("0", 100, 4, "", "empty"), ("0", 100, 5, " ", "empty"),
        ("1", 1, 1, "A", "as_is"), ("1", 1, 2, "A", "as_is"),
        ("2", 1, 1, " ", "empty"), ("2", 1, 2, "\t", "empty"),
    ]
    stats = {r.sheet: (r.headers_found, r.empty_headers, r.raw_headers) for r in H.sheet_scan_stats(bounds, headers).collect()}
    assert stats == {"0": (2, 3, 5), "1": (2, 0, 2), "2": (0, 2, 2), "3": (0, 0, 0)}
    assert [r.sheet for r in H.sheets_without_valid_headers(H.sheet_scan_stats(bounds, headers)).collect()] == ["2"]
    inputs = {(r.sheet, r.header): (r.first_col, r.value_col) for r in H.input_headers(headers).collect()}
    assert inputs == {("0", "A"): (1, 1), ("0", "B"): (3, 3), ("1", "A"): (1, 2)}


def test_headers_holding_zero_or_false_name_nothing(spark):
    cells = [("0", "n", "General"), ("FALSE", "b", "General"), ("0", "s", "General"), ("x", "s", "General")]
    grid = spark.createDataFrame([("f", 0, "s", 1, cells)], GRID_SCHEMA)
    headers = H.clean_headers(H.sheet_headers(grid, B.sheet_bounds(grid)))
    assert {(r.header, r.value_col) for r in H.input_headers(headers).collect()} == {("0", 3), ("x", 4)}
    assert [r.target for r in H.target_layout(headers).orderBy("target_col").collect()] == ["", "", "0", "x"]


def random_mapping(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [
        (i, rng.choice(["h0", "h1", "h2", "h3", "h4"]), rng.choice(["a", "b", "c", "", "d"]), rng.choice([True, False, False, None]))
        for i in range(6)
    ]


def plan_of(sheet: dict[int, list], mapping: list[tuple], header_row: int) -> dict[str, int]:
    """Target to source column, restated with dictionaries."""
    targets: dict[str, str] = {}
    ignored = set()
    for _, scanned, target, is_ignored in mapping:
        if is_ignored:
            ignored.add(scanned)
        elif target:
            targets[scanned] = target
    columns: dict[str, int] = {}
    for col, text in enumerate(sheet.get(header_row, []), 1):
        name = (text or "").replace("<b>", "").replace("</b>", "").strip()
        if name:
            columns[name] = col
    plan: dict[str, int] = {}
    for target in ("a", "b", "c"):
        for name, col in columns.items():
            if name not in ignored and targets.get(name) == target:
                plan[target] = col
                break
    return plan


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("row_block", [3, 1 << 17])
def test_format(spark, seed, row_block):
    sheets = random_sheets(60, seed, header=True)
    mapping = random_mapping(seed)
    grid = grid_of(spark, sheets)
    bounds = B.sheet_bounds(grid)
    headers = H.clean_headers(H.sheet_headers(grid, bounds))
    stored = spark.createDataFrame(mapping, "ord int, scanned string, target string, is_ignored boolean")
    applicable = Fm.applicable_mappings(H.input_headers(headers), M.normalize_mapping(stored), LAYOUT)
    plans = Fm.sheet_plans(bounds, applicable, LAYOUT)
    assert LAYOUT.columns == ["a", "b", "a_4", "c"]

    aligned, kept, dense, summary = {}, {}, {}, {}
    for name, sheet in sheets.items():
        header_row = bounds_of(sheet, 1)[1]
        plan = plan_of(sheet, mapping, header_row)
        data = {}
        formulas = 0
        for row in range(header_row + 1, max(sheet) + 1):
            values = sheet.get(row, [])

            def at(target):
                col = plan.get(target)
                return values[col - 1] if col and col <= len(values) else None

            picked = [at(t) for t in ("a", "b", "a", "c")]
            formulas += sum((v or "").startswith("=") for v in picked)
            data[2 + row - header_row] = tuple(None if (v or "").startswith("=") else v for v in picked)
            if row in sheet:
                aligned[name, 2 + row - header_row] = data[2 + row - header_row]
        good = [v for _, v in sorted(data.items()) if any(filled(x) for x in v)]
        kept.update({(name, 3 + i): v for i, v in enumerate(good)})
        dense.update({(name, r): v for r, v in data.items()})
        mapped = sum(t in plan for t in ("a", "b", "a", "c"))
        copied = sum(filled(x) for v in data.values() for x in v)
        summary[name] = (4, mapped, 4 - mapped, copied, formulas, len(data) - len(good))

    def result(df):
        return {(r.sheet, r.target_row): tuple(r[c] for c in LAYOUT.columns) for r in df.collect()}

    rows = Fm.as_columns(Fm.project_values(grid, plans, LAYOUT, row_block=row_block), LAYOUT)
    assert result(rows) == aligned
    assert result(Fm.format_sheets(grid, plans, LAYOUT, row_block=row_block)) == kept
    assert result(Fm.format_sheets(grid, plans, LAYOUT, drop_empty=False, row_block=row_block)) == dense
    report = R.format_summary(Fm.project_cells(grid, plans, LAYOUT, row_block=row_block), plans, LAYOUT)
    assert {r.sheet: tuple(r)[2:] for r in report.collect()} == summary


def test_footer_is_kept_unless_asked(spark):
    sheets = {"0": {1: ["h0", "x"], 2: ["1", "2"], 3: ["3", "4"], 6: ["total", None]}}
    grid = grid_of(spark, sheets)
    bounds = B.table_end(grid, B.sheet_bounds(grid), 1)
    stored = spark.createDataFrame([(0, "h0", "a", False)], "ord int, scanned string, target string, is_ignored boolean")
    headers = H.clean_headers(H.sheet_headers(grid, bounds))
    plans = Fm.sheet_plans(bounds, Fm.applicable_mappings(H.input_headers(headers), M.normalize_mapping(stored), LAYOUT), LAYOUT)
    whole = Fm.format_sheets(grid, plans, LAYOUT).orderBy("target_row").collect()
    assert [r.a for r in whole] == ["1", "3", "total"]
    assert [r.target_row for r in whole] == [3, 4, 5]
    cut = Fm.format_sheets(grid, plans, LAYOUT, stop_at_table_end=True).orderBy("target_row").collect()
    assert [r.a for r in cut] == ["1", "3"]
    gaps = Fm.format_sheets(grid, plans, LAYOUT, renumber=False).orderBy("target_row").collect()
    assert [r.target_row for r in gaps] == [3, 4, 7]


@pytest.mark.parametrize("row_block", [2, 1 << 17])
def test_template_cells_stay_around_the_rows(spark, row_block):
    layout = Fm.Layout(("a.b", "", "c`d"), header_row=2)
    template = grid_of(spark, {"9": {1: ["Title"], 2: ["a.b", None, "c`d"], 3: ["old", "note", "old"], 4: ["old", "=B1"], 6: [None, "end"]}})
    grid = grid_of(spark, {"0": {1: ["h0", "h1"], 3: ["1", " "], 4: [None, "x"]}, "1": {1: ["h1"]}})
    bounds = B.sheet_bounds(grid)
    entries = [(0, "h0", "a.b", False), (1, "h1", "c`d", False)]
    stored = spark.createDataFrame(entries, "ord int, scanned string, target string, is_ignored boolean")
    headers = H.clean_headers(H.sheet_headers(grid, bounds))
    applicable = Fm.applicable_mappings(H.input_headers(headers), M.normalize_mapping(stored), layout)
    plans = Fm.sheet_plans(bounds, applicable, layout)
    rows = Fm.format_sheets(grid, plans, layout, renumber=False, row_block=row_block)
    merged = Fm.template_overlay(rows, template, bounds, layout, row_block=row_block)
    assert merged.columns == ["file", "sheet", "target_row", "a.b", "column_2", "c`d"]
    found = {(r[1], r[2]): tuple(r)[3:] for r in merged.collect()}
    top = {1: ("Title", None, None), 2: ("a.b", None, "c`d")}
    assert found == {
        **{("0", n): v for n, v in {**top, 3: (None, "note", None), 4: ("1", "=B1", " "), 5: (None, None, "x"), 6: (None, "end", None)}.items()},
        **{("1", n): v for n, v in {**top, 3: (None, "note", None), 4: (None, "end", None)}.items()},
    }


def test_layout_reads_its_columns_in_order(spark):
    table = spark.createDataFrame([("b", 3), ("", 2), ("A", 1), ("a", 4)], "target string, target_col int")
    layout = Fm.Layout.of(table, 5)
    assert layout.targets == ("A", "", "b", "a")
    assert layout.columns == ["A", "b", "a_4"]
    assert Fm.Layout(("x.y", "sheet")).columns == ["x.y", "sheet_2"]


def test_long_and_dense_cells_are_the_same(spark):
    sheets = random_sheets(20, seed=9)
    grid = grid_of(spark, sheets)
    cells = grid_to_cells(grid)
    back = cells_to_grid(cells)
    assert dict(back.dtypes)["cells"] == f"array<{CELL_TYPE}>"
    want = {(r.sheet, r.row, r.col, r.value) for r in cells.collect()}
    got = {(r.sheet, r.row, r.col, r.value) for r in grid_to_cells(back).collect()}
    assert got == want and len(want) > 50


def test_stored_buckets_are_not_shuffled(spark, tmp_path):
    from tabrecover.sinks.writers import land_grid

    sheets = random_sheets(30, seed=3, header=True)
    grid = grid_of(spark, sheets)
    landed = land_grid(grid, str(tmp_path / "grid"), "landed_grid", buckets=4)
    bounds = B.sheet_bounds(landed)
    plans = bounds.withColumn("input_cols", F.array(F.lit(1), F.lit(None), F.lit(2), F.lit(3)))
    plans.write.parquet(str(tmp_path / "plans"))
    plans = spark.read.parquet(str(tmp_path / "plans"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = Fm.format_sheets(landed, plans, LAYOUT, renumber=False)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        # one exchange, on the side of the plans
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert "Bucketed: true" in plan
        heads = H.sheet_headers(landed, plans)
        plan = heads._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
        assert kept.count() == Fm.format_sheets(grid, plans, LAYOUT, renumber=False).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_one_projection_serves_all(spark, tmp_path):
    """Rows from the stored projection are those of the direct way; the grid is read once and not shuffled."""
    from tabrecover.plans.checkpoints import stored
    from tabrecover.sinks.writers import land_grid

    grid = grid_of(spark, random_sheets(30, seed=8, header=True))
    landed = land_grid(grid, str(tmp_path / "grid"), "landed_once", buckets=4)
    bounds = B.sheet_bounds(landed)
    plans = stored(bounds.withColumn("input_cols", F.array(F.lit(1), F.lit(None), F.lit(2), F.lit(3))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        once = Fm.project_once(landed, plans, LAYOUT)
        plan = once._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
        assert plan.count("FileScan") == 2, plan
        projected = stored(once)
        rows = Fm.format_projected(projected, plans, LAYOUT)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "landed_once" not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    for block in (1 << 17, 5):
        projected = stored(Fm.project_once(grid, plans, LAYOUT, row_block=block))
        for how in ({}, {"renumber": False}, {"drop_empty": False}):
            want = Fm.format_sheets(grid, plans, LAYOUT, row_block=block, **how)
            got = Fm.format_projected(projected, plans, LAYOUT, row_block=block, **how)
            assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
