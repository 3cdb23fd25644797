"""The three phases as jobs: scan, map, format.

Each reads its inputs from folders, writes its outputs to folders and can run
by itself; the decoded workbooks are stored once and used by scan and format.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrecover.operators import bounds as B
from tabrecover.operators import decisions as D
from tabrecover.operators import formatting as Fm
from tabrecover.operators import headers as H
from tabrecover.operators import mapping as M
from tabrecover.operators import reports as R
from tabrecover.operators import suggest as S
from tabrecover.operators import types as T
from tabrecover.plans import checkpoints as C
from tabrecover.plans.blocks import blocked
from tabrecover.sinks import store as St
from tabrecover.sinks import writers as W
from tabrecover.sources import workbook as X
from tabrecover.sources.files import list_files
from tabrecover.sources.pieces import decode_in_pieces


Scorer = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    """Parameters of a run."""

    table_end_tolerance: int = B.DEFAULT_TOLERANCE
    drop_empty: bool = True
    stop_at_table_end: bool = False
    min_confidence: float = S.MIN_CONFIDENCE
    typed: bool = True
    named: bool = False


def ingest(
    spark: SparkSession,
    roots: Sequence[str],
    path: str,
    partitions: int | None = None,
    table: str | None = None,
    buckets: int = 0,
    in_pieces: bool = False,
) -> DataFrame:
    """Decode all workbooks below the roots into one stored table.

    ``in_pieces`` is for long sheets or string tables: several tasks then share a sheet.
    With a table name and a number of buckets (some per executor core) the rows are
    stored by sheet and row block, and scan and format leave them where they are.
    """
    decode = decode_in_pieces if in_pieces else X.decode_workbooks
    decoded = decode(list_files(spark, roots), partitions=partitions)
    return W.land_grid(decoded, path, table, buckets)


def ingest_new(
    spark: SparkSession, roots: Sequence[str], path: str, partitions: int | None = None
) -> DataFrame:
    """Decode the workbooks that a stored table does not hold yet and add them to it.

    Files are known by their path; a workbook changed in place is not read again.
    """
    stored_rows = spark.read.parquet(path)
    known = stored_rows.select("file").distinct()
    new = list_files(spark, roots).join(known, "file", "left_anti")
    decoded = X.decode_workbooks(new, partitions=partitions)
    blocked(decoded).write.mode("append").parquet(path)
    return spark.read.schema(stored_rows.schema).parquet(path)


def ingest_changed(
    spark: SparkSession, roots: Sequence[str], path: str, partitions: int | None = None
) -> DataFrame:
    """Bring a store of files and versions up to date and give its live rows.

    New and changed workbooks are decoded, those that the folders no longer hold are left out, all
    in one step (``sinks.store``).
    """
    St.ingest_changed(spark, roots, path, partitions)
    return St.current(spark, path)


def scan(decoded: DataFrame, path: str, history: str | None = None, run: str = "") -> None:
    """Write headers, their provenance and the statistics of a scan.

    With a ``history`` folder the statistics per file are also kept there under the name of
    the ``run``; a run that is repeated replaces its own.
    """
    grid, rejects = X.grid_of(decoded), X.rejects_of(decoded)
    bounds = C.stored(B.sheet_bounds(grid))
    headers = C.stored(H.clean_headers(H.sheet_headers(grid, bounds)))
    provenance = H.header_provenance(headers)
    provenance.write.parquet(f"{path}/provenance")
    spark = decoded.sparkSession
    stored = spark.read.schema(provenance.schema).parquet(f"{path}/provenance")
    W.write_lines(stored, f"{path}/scanned_columns")
    sheets = H.sheet_scan_stats(bounds, headers)
    sheets.write.parquet(f"{path}/sheet_stats")
    sheets = spark.read.schema(sheets.schema).parquet(f"{path}/sheet_stats")
    files = H.file_scan_stats(sheets, rejects)
    files.write.parquet(f"{path}/file_stats")
    files = spark.read.schema(files.schema).parquet(f"{path}/file_stats")
    W.write_report(H.total_scan_stats(files, stored), f"{path}/total_stats")
    if history is not None:
        W.append_stats(files, f"{history}/file_stats", run)


def map_headers(
    scanned: DataFrame,
    targets: DataFrame,
    stored: DataFrame,
    log: DataFrame,
    path: str,
    settings: Settings = Settings(),
    replies: DataFrame | None = None,
    scorer: Scorer | None = None,
    history: str | None = None,
    run: str = "",
) -> DataFrame:
    """Fold the review log over the stored mapping and exact matches; write the mapping,
    what is still open, the session state, coverage and fan-in.

    ``scanned`` has pos, header. Open headers get suggestions from ``replies`` (reply,
    text: answers to ``request_texts``), with an audit of what was asked, or else from a
    scorer, a function from open headers and targets to scanned, target; without
    either from the built-in one. With a ``history`` folder the audit is kept there by ``run``. Gives the session state.
    """
    normalized = M.normalize_mapping(stored)
    exact = M.auto_map_exact(scanned, normalized, targets)
    before = D.mapping_as_log(normalized).unionByName(
        D.mapping_as_log(exact.selectExpr("scanned", "target", "false as is_ignored"))
    )
    states = D.fold_decisions(before.unionByName(log))
    entries = C.stored(D.saved_mapping(states))
    W.write_mapping(entries, f"{path}/mapping")
    open_headers = C.stored(M.unmapped_headers(scanned, entries).select("pos", "header"))
    W.write_report(open_headers, f"{path}/unmapped")
    final = C.stored(M.normalize_mapping(entries.selectExpr("0 as ord", "*")))
    if replies is not None:
        accepted = C.stored(S.accept_suggestions(S.parse_suggestions(replies), settings.min_confidence))
        suggested = S.apply_suggestions(accepted, final, targets).filter("in_targets")
        sent = S.suggestion_batches(open_headers.select("header").distinct()).drop("batch")
        audit = C.stored(S.suggestion_audit(sent, accepted))
        W.write_report(audit, f"{path}/audit")
        if history is not None:
            W.append_stats(audit, f"{history}/audit", run)
    elif scorer is not None:
        suggested = scorer(open_headers, targets)
    else:
        suggested = S.suggest_similar(open_headers, targets, settings.min_confidence)
    nothing = exact.limit(0)
    session = M.merge_mapping(final, nothing, suggested.select("scanned", "target"))
    session.write.parquet(f"{path}/session")
    session = scanned.sparkSession.read.schema(session.schema).parquet(f"{path}/session")
    W.write_report(M.mapping_coverage(scanned, session), f"{path}/coverage")
    W.write_report(M.mapping_fan_in(final, targets), f"{path}/fan_in")
    return session


def request_texts(path: str, targets: DataFrame, out: str) -> None:
    """Write the requests for the open headers of a mapping run: batch, headers, request."""
    spark = targets.sparkSession
    schema = "pos bigint, header string"
    open_headers = spark.read.schema(schema).options(**W.CSV_OPTIONS).csv(f"{path}/unmapped")
    batches = S.suggestion_batches(open_headers.select("header").distinct())
    W.write_report(S.batch_requests(batches, targets), out, "parquet")


def extend_targets(existing: DataFrame, file: str, sheet: str, path: str) -> None:
    """Write the target list with the headers of a template sheet that it lacks, after the old ones."""
    grid, _ = template(existing.sparkSession, file, sheet)
    headers = H.sheet_headers(grid, B.sheet_bounds(grid)).select("col", "text")
    W.write_lines(M.append_targets(existing, headers), path, "target", order=("part", "pos"))


def format_all(
    decoded: DataFrame,
    mapping: DataFrame,
    layout: Fm.Layout,
    path: str,
    settings: Settings = Settings(),
    fmt: str = "parquet",
    overlay: DataFrame | None = None,
) -> None:
    """Write all sheets in the target layout, the columns' types and formats, the summary
    per sheet and the rejects. After bounds and headers the grid is read once.

    With ``typed`` a column has the type that holds all its values, else all are text.
    ``overlay`` is the grid of the template sheet; its own cells are then kept, as text.
    With ``named`` the folder of a sheet is called "<file stem>-<sheet>" (``reports.unique_names``).

    The folder must be new. ``sinks.publish`` runs this or another job below a fresh one, so
    that all outputs count at once and a run after a failure replaces its own.
    """
    grid, broken = X.grid_of(decoded), X.rejects_of(decoded)
    bounds = B.sheet_bounds(grid)
    if settings.stop_at_table_end:
        bounds = B.table_end(grid, bounds, settings.table_end_tolerance)
    bounds = C.stored(bounds)
    headers = H.clean_headers(H.sheet_headers(grid, bounds))
    applicable = Fm.applicable_mappings(H.input_headers(headers), M.normalize_mapping(mapping), layout)
    plans = Fm.sheet_plans(bounds, applicable, layout)
    plans.write.parquet(f"{path}/plans")
    plans = decoded.sparkSession.read.schema(plans.schema).parquet(f"{path}/plans")
    projected = C.stored(Fm.project_once(grid, plans, layout, stop_at_table_end=settings.stop_at_table_end))
    rows = Fm.format_projected(projected, plans, layout, drop_empty=settings.drop_empty)
    formats = T.column_formats(T.column_profile(projected, layout))
    formats.write.parquet(f"{path}/columns")
    formats = decoded.sparkSession.read.schema(formats.schema).parquet(f"{path}/columns")
    if overlay is not None:
        aligned = Fm.format_projected(projected, plans, layout, renumber=False)
        rows = Fm.template_overlay(aligned, overlay, plans, layout, drop_empty=settings.drop_empty)
    elif settings.typed:
        rows = T.typed_rows(rows, T.column_types(formats))
    if settings.named:
        names = R.unique_names(bounds)
        names.write.parquet(f"{path}/names")
        names = decoded.sparkSession.read.schema(names.schema).parquet(f"{path}/names")
        W.write_named_sheets(rows, names, f"{path}/sheets", fmt)
    else:
        W.write_sheets(rows, f"{path}/sheets", fmt)
    W.write_report(R.format_summary(projected, plans, layout), f"{path}/summary", "parquet")
    stats = H.sheet_scan_stats(bounds, headers)
    rejects = broken.unionByName(R.sheet_rejects(stats, plans))
    rejects.write.parquet(f"{path}/rejects")
    rejects = decoded.sparkSession.read.schema(rejects.schema).parquet(f"{path}/rejects")
    W.write_report(R.batch_summary(plans, rejects), f"{path}/batch_summary")


def template(spark: SparkSession, file: str, sheet: str) -> tuple[DataFrame, Fm.Layout]:
    """Grid and layout of the sheet of a template workbook."""
    one = spark.createDataFrame([(file,)], "file string")
    grid = X.grid_of(X.decode_workbooks(one, formulas=True, partitions=1)).filter(F.col("sheet") == sheet)
    bounds = B.sheet_bounds(grid)
    found = bounds.first()
    if found is None:
        raise ValueError(f"no readable sheet {sheet!r} in {file}")
    header_row = found.header_row
    return grid, Fm.Layout.of(H.target_layout(H.sheet_headers(grid, bounds)), header_row)
