"""Files that come, change and go, against a fresh ingest of what is there."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabrecover import jobs
from tabrecover.grid import grid_to_cells
from tabrecover.operators import bounds as B
from tabrecover.operators import headers as H
from tabrecover.plans.checkpoints import stored
from tabrecover.sinks import store
from tabrecover.sources.files import list_files
from tabrecover.sources.workbook import decode_workbooks, grid_of, rejects_of
from workload.xlsx import Cell, workbook


def book(rng):
    """A workbook of one or two sheets; now and then a broken one."""
    if rng.random() < 0.2:
        return b"broken"
    sheets = []
    for i in range(rng.randint(1, 2)):
        names = rng.sample(["id", "name ", "<b>qty</b>", "price", " ", "note"], 3)
        rows = {1: {c: Cell("s", n) for c, n in enumerate(names, 1)}}
        rows |= {r: {c: Cell("n", rng.randrange(100)) for c in range(1, 4)} for r in range(2, rng.randint(3, 9))}
        sheets.append((f"s{i}", rows))
    return workbook(sheets)


def fresh(spark, folder):
    decoded = stored(decode_workbooks(list_files(spark, [folder]), partitions=2))
    grid = grid_of(decoded)
    bounds = stored(B.sheet_bounds(grid))
    headers = stored(H.clean_headers(H.sheet_headers(grid, bounds)))
    files = H.file_scan_stats(H.sheet_scan_stats(bounds, headers), rejects_of(decoded))
    return decoded, files, H.header_provenance(headers)


def rows_of(df):
    return sorted(str(sorted(r.asDict(True).items())) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_store_is_a_fresh_ingest(spark, tmp_path, seed):
    rng = random.Random(seed)
    folder, path = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    versions = []
    for turn in range(4):
        for n in rng.sample(range(8), 5 if turn == 0 else 3):
            file = folder / f"b{n}.xlsx"
            if file.exists() and rng.random() < 0.3:
                file.unlink()
            else:
                file.write_bytes(book(rng) + b"\0" * turn)  # another length in any case
        versions.append(store.ingest_changed(spark, [str(folder)], path, partitions=2))
        if turn == 2:
            versions.append(store.compact(spark, path))
        decoded, files, provenance = fresh(spark, str(folder))
        assert rows_of(grid_to_cells(grid_of(store.current(spark, path)))) == rows_of(grid_to_cells(grid_of(decoded)))
        assert rows_of(rejects_of(store.current(spark, path))) == rows_of(rejects_of(decoded))
        _, kept_files, kept_provenance = store.scan_stats(spark, path)
        assert rows_of(kept_files) == rows_of(files) and rows_of(kept_provenance) == rows_of(provenance)
        assert rows_of(H.total_scan_stats(kept_files, kept_provenance)) == rows_of(H.total_scan_stats(files, provenance))
    assert versions == [1, 2, 3, 4, 5]
    assert store.ingest_changed(spark, [str(folder)], path) is None


def test_only_changed_files_are_decoded(spark, tmp_path):
    rng = random.Random(3)
    folder, path = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    good = workbook([("s", {1: {1: Cell("s", "a")}, 2: {1: Cell("n", 1)}})])
    for n in range(4):
        (folder / f"b{n}.xlsx").write_bytes(good)
    jobs.ingest_changed(spark, [str(folder)], path)
    (folder / "b1.xlsx").write_bytes(workbook([("s", {1: {1: Cell("s", "b")}, 2: {1: Cell("n", 22)}})]))
    (folder / "b9.xlsx").write_bytes(good)
    current = jobs.ingest_changed(spark, [str(folder)], path)
    second = spark.read.parquet(f"{path}/rows/version=2").select("file").distinct()
    assert {r.file.rsplit("/", 1)[1] for r in second.collect()} == {"b1.xlsx", "b9.xlsx"}
    assert {(r.file.rsplit("/", 1)[1], r.version) for r in store.ledger(spark, path).collect()} == {
        ("b0.xlsx", 1), ("b1.xlsx", 2), ("b2.xlsx", 1), ("b3.xlsx", 1), ("b9.xlsx", 2),
    }
    assert {r.cells[0].value for r in current.filter(F.col("file").endswith("b1.xlsx")).collect()} == {"b", "22"}
    assert rng


def test_a_run_without_commit_does_not_count(spark, tmp_path, monkeypatch):
    folder, path = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.xlsx").write_bytes(workbook([("s", {1: {1: Cell("s", "old")}})]))
    store.ingest_changed(spark, [str(folder)], path)
    (folder / "a.xlsx").write_bytes(workbook([("s", {1: {1: Cell("s", "newer")}})]))

    def lost(*_):
        raise OSError("lost before the commit")

    with monkeypatch.context() as patch:
        patch.setattr(store, "_commit", lost)
        with pytest.raises(OSError):
            store.ingest_changed(spark, [str(folder)], path)
    assert [r.cells[0].value for r in store.current(spark, path).collect()] == ["old"]
    assert store.ingest_changed(spark, [str(folder)], path) == 2
    assert [r.cells[0].value for r in store.current(spark, path).collect()] == ["newer"]


def test_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = str(tmp_path / "store")
    assert store.ingest_changed(spark, [str(tmp_path / "in")], path) == 1
    assert store.current(spark, path).count() == 0 and store.ledger(spark, path).count() == 0
