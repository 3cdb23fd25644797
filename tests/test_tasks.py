"""The number of tasks follows the rows, and what is stored by its keys stays where it is."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF
from tabrecover.operators import formatting as Fm
from tabrecover.plans import checkpoints as C
from tabrecover.sinks import writers as W
from workload import fixtures as X
from workload import queries as Q


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert C.tasks_for(spark, 0) == C.tasks_for(spark, 7) == least
    assert C.tasks_for(spark, 250 * C.TASK_ROWS) == 250
    assert C.tasks_for(spark, 250 * C.TASK_ROWS + 1) == 251


def test_grid_and_bounds_are_not_dealt_out_again(spark):
    """One shuffle for the bounds' rows by block, none for the cells."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(Q._headers(spark, SF)[1])
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    grid = Q.landed(spark, SF, X.order_grid)
    assert grid.rdd.getNumPartitions() > 0 and grid.count() == X.order_grid(spark, SF).count()


def test_filled_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(C, "TASK_ROWS", 10)
    layout = Fm.Layout(("a",))
    extent = spark.createDataFrame([("f", "s", 101), ("f", "t", 50)], "file string, sheet string, last_target_row bigint")
    formatted = spark.createDataFrame([("f", "s", 7, ["x"])], "file string, sheet string, target_row bigint, picked array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = Fm.fill_rows(formatted, extent, layout)
        assert "hashpartitioning(file#" in plan_of(rows) and rows.rdd.getNumPartitions() == 16
        assert rows.count() == 149 and rows.filter("picked is not null").count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_uncovered_targets_joins_sheets_not_targets(spark):
    bounds = spark.createDataFrame([("f", "s"), ("f", "t"), (None, "u")], "file string, sheet string")
    applicable = spark.createDataFrame(
        [("f", "s", "b"), ("f", "s", "b"), (None, "u", "a")], "file string, sheet string, target string"
    )
    found = Fm.uncovered_targets(bounds, applicable, Fm.Layout(("a", "b", "", "a")))
    assert sorted(map(tuple, found.collect()), key=str) == [
        ("f", "s", "a"), ("f", "t", "a"), ("f", "t", "b"), (None, "u", "a"), (None, "u", "b"),
    ]
    assert "target" not in plan_of(found).split("Join")[1].split("\n")[0]


def tasks_of(spark, group: str) -> list[int]:
    """Tasks of the stages that ran under a job group, most last."""
    tracker = spark.sparkContext.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sorted(info.numTasks for info in map(tracker.getStageInfo, stages) if info)


def test_folders_of_sheets_go_to_tasks_by_cores(spark, tmp_path):
    """Small sheets are written by more tasks than their bytes ask for, and listed by fewer than there are folders."""
    rows = spark.createDataFrame([("f", f"s{n}", 2, "x") for n in range(60)], "file string, sheet string, target_row bigint, a string")
    names = rows.select("file", "sheet", F.col("sheet").alias("output"))
    most = C.tasks_for_files(spark)
    assert most == 4 * spark.sparkContext.defaultParallelism < 60
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    listing = spark.conf.get(key, None)
    try:
        for group, write in (("plain", lambda p: W.write_sheets(rows, p)), ("named", lambda p: W.write_named_sheets(rows, names, p))):
            path = str(tmp_path / group)
            spark.sparkContext.setJobGroup(f"write {group}", "")
            write(path)
            assert tasks_of(spark, f"write {group}")[-1] == most
            spark.sparkContext.setJobGroup(f"list {group}", "")
            found = W.read_sheets(spark, path, rows.schema)
            assert tasks_of(spark, f"list {group}")[-1] == most
            assert spark.conf.get(key, None) == listing
            assert sorted(found.collect()) == sorted(rows.collect())
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
