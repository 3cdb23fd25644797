"""One query per operator over the whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrecover.functions.text import cell_ref, clean_header, column_letter, is_formula, suppress_formula
from tabrecover.grid import grid_to_cells
from tabrecover.operators import bounds as B
from tabrecover.operators import decisions as D
from tabrecover.operators import formatting as Fm
from tabrecover.operators import headers as H
from tabrecover.operators import mapping as M
from tabrecover.operators import reports as R
from tabrecover.operators import suggest as S
from tabrecover.operators import types as T
from tabrecover.plans.blocks import blocked
from tabrecover.plans.checkpoints import checkpoint_dir, stored, stored_in_buckets, tasks_for
from tabrecover.sinks import publish as Pb
from tabrecover.sinks import store as St
from tabrecover.sinks import writers as W
from tabrecover.sources import datasource as Ds
from tabrecover.sources.files import list_files
from tabrecover.sources.lists import clean_lines, mapping_entries, read_lines, read_mapping, read_targets
from tabrecover.sources.pieces import decode_in_pieces
from tabrecover.sources.tables import table_to_grid
from tabrecover.sources.workbook import decode_workbooks, grid_of, rejects_of
from tabrecover.streaming.decision_state import keep_decisions
from tabrecover.streaming.decisions import LOG_SCHEMA, current_states
from workload import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(make: Query) -> Query:
    QUERIES[make.__name__] = make
    return make


_LANDED: dict[tuple[str, str, str], DataFrame] = {}
_STORES: dict[tuple[str, str, str], str] = {}


def landed(spark: SparkSession, sf_dir: str, make: Query) -> DataFrame:
    """A fixture's grid stored as decoding leaves it, the rows of a sheet block in one place.

    A session stores each grid once, as a run of several jobs does.
    """
    key = (spark.sparkContext.applicationId, sf_dir, make.__name__)
    if key not in _LANDED:
        at, tasks = ["file", "sheet", "block"], _tasks(spark, sf_dir, make)
        if make.__name__ in X.NARROW:
            rows, cells = X.NARROW[make.__name__]
            _LANDED[key] = stored_in_buckets(cells(blocked(rows(spark, sf_dir)).repartition(tasks, *at)), at, tasks, dealt=True)
        else:
            _LANDED[key] = stored_in_buckets(blocked(make(spark, sf_dir)), at, tasks)
    return _LANDED[key]


def _tasks(spark: SparkSession, sf_dir: str, make: Query) -> int:
    """Tasks for the rows of a fixture's grid, by the rows of the tables that it is made of."""
    return tasks_for(spark, sum(X.table(spark, sf_dir, name).count() for name in X.SOURCES[make.__name__]))


def _bounds(spark: SparkSession, sf_dir: str, make: Query) -> DataFrame:
    """The bounds of a fixture's sheets, stored by sheet for the joins of what is known of sheets."""
    return stored_in_buckets(B.sheet_bounds(landed(spark, sf_dir, make)), ["file", "sheet"], _tasks(spark, sf_dir, make))


# --- sources ---------------------------------------------------------------


@query
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from the parts, some empty and some locks, in folders of three levels, found again."""
    folder = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    X.part_files(spark, sf_dir, folder)
    return list_files(spark, [folder]).select("name", "length", "audit")


@query
def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks written from the customers, found and decoded."""
    folder = f"{checkpoint_dir(spark)}/books-{uuid.uuid4().hex}"
    X.customer_workbooks(spark, sf_dir, folder)
    decoded = decode_workbooks(list_files(spark, [folder]))
    cells = grid_to_cells(grid_of(decoded))
    return cells.withColumn("file", F.element_at(F.split("file", "/"), -1))


@query
def workbook_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer workbooks cut into pieces of sheets and blocks of strings, each decoded by itself."""
    folder = f"{checkpoint_dir(spark)}/books-{uuid.uuid4().hex}"
    X.customer_workbooks(spark, sf_dir, folder)
    decoded = decode_in_pieces(list_files(spark, [folder]), piece_bytes=1 << 13, strings=64)
    return grid_to_cells(grid_of(decoded)).withColumn("file", F.element_at(F.split("file", "/"), -1))


@query
def workbook_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet of each customer workbook through the data source, which opens no other."""
    folder = f"{checkpoint_dir(spark)}/books-{uuid.uuid4().hex}"
    X.customer_workbooks(spark, sf_dir, folder)
    Ds.register(spark)
    found = spark.read.format("workbook").load(folder).filter(F.col("sheet") == "part 1")
    return grid_to_cells(grid_of(found)).withColumn("file", F.element_at(F.split("file", "/"), -1))


def _line_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks of order lines, written and decoded; a session does so once."""
    key = (spark.sparkContext.applicationId, sf_dir, "line_books")
    if key not in _LANDED:
        folder = f"{checkpoint_dir(spark)}/books-{uuid.uuid4().hex}"
        X.line_workbooks(spark, sf_dir, folder)
        _LANDED[key] = stored(decode_workbooks(list_files(spark, [folder])))
    return _LANDED[key]


@query
def decode_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per workbook of order lines: rows read, cells in error, and sheets or files rejected."""
    return _read_and_rejected(_line_books(spark, sf_dir))


@query
def rejects_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same books decoded in pieces: a broken sheet gives none of them."""
    folder = f"{checkpoint_dir(spark)}/books-{uuid.uuid4().hex}"
    X.line_workbooks(spark, sf_dir, folder)
    return _read_and_rejected(stored(decode_in_pieces(list_files(spark, [folder]), piece_bytes=1 << 16)))


def _read_and_rejected(decoded: DataFrame) -> DataFrame:
    errors = F.size(F.filter("cells.dtype", lambda t: t == "e")).cast("bigint")
    rows = grid_of(decoded).select("file", F.lit(1).alias("rows"), errors.alias("errors"), F.lit(0).alias("rejects"))
    rejects = rejects_of(decoded).select("file", F.lit(0).alias("rows"), F.lit(0).cast("bigint").alias("errors"), F.lit(1).alias("rejects"))
    name = F.element_at(F.split("file", "/"), -1).alias("file")
    return rows.unionByName(rejects).groupBy(name).agg(*[F.sum(c).alias(c) for c in ("rows", "errors", "rejects")])


def _line_book_stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    decoded = _line_books(spark, sf_dir)
    grid, rejects = grid_of(decoded), rejects_of(decoded)
    bounds = stored(B.sheet_bounds(grid))
    headers = stored(H.clean_headers(H.sheet_headers(grid, bounds)))
    return H.file_scan_stats(H.sheet_scan_stats(bounds, headers), rejects), H.header_provenance(headers)


@query
def scan_stats_broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan statistics of the workbooks of order lines, with what could not be read."""
    files, _ = _line_book_stats(spark, sf_dir)
    return files.withColumn("file", F.element_at(F.split("file", "/"), -1))


@query
def scan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets, files and the total of the workbooks of order lines from one aggregate."""
    decoded = _line_books(spark, sf_dir)
    grid = grid_of(decoded)
    bounds = stored(B.sheet_bounds(grid))
    headers = stored(H.clean_headers(H.sheet_headers(grid, bounds)))
    found = H.scan_rollup(bounds, headers, rejects_of(decoded))
    return found.withColumn("file", F.element_at(F.split("file", "/"), -1))


@query
def scan_stats_broken_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.total_scan_stats(*_line_book_stats(spark, sf_dir))


def _part_store(spark: SparkSession, sf_dir: str) -> str:
    """A store of part workbooks after a second run: some books changed, some new, a folder no longer listed."""
    key = (spark.sparkContext.applicationId, sf_dir, "part_store")
    if key not in _STORES:
        folder = f"{checkpoint_dir(spark)}/books-{uuid.uuid4().hex}"
        path = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
        X.part_workbooks(spark, sf_dir, folder, again=False)
        St.ingest_changed(spark, [f"{folder}/a", f"{folder}/b"], path)
        X.part_workbooks(spark, sf_dir, folder, again=True)
        St.ingest_changed(spark, [f"{folder}/a"], path)
        _STORES[key] = path
    return _STORES[key]


@query
def ingest_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a store whose files were changed, added and taken away between two runs."""
    cells = grid_to_cells(grid_of(St.current(spark, _part_store(spark, sf_dir))))
    return cells.withColumn("file", F.element_at(F.split("file", "/"), -1)).drop("number_format")


@query
def file_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live files of the store and the run that read each."""
    files = St.ledger(spark, _part_store(spark, sf_dir))
    return files.select(F.element_at(F.split("file", "/"), -1).alias("file"), "version")


@query
def kept_scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over the store's kept headers, without reading a sheet again."""
    _, files, provenance = St.scan_stats(spark, _part_store(spark, sf_dir))
    return H.total_scan_stats(files, provenance)


@query
def kept_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First place and number of occurrences of each header of the store's live files."""
    _, _, provenance = St.scan_stats(spark, _part_store(spark, sf_dir))
    return provenance.withColumn("first_file", F.element_at(F.split("first_file", "/"), -1))


@query
def table_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = X.table(spark, sf_dir, "events")
    grid = table_to_grid(
        events,
        F.lit("events"),
        F.col("event_type"),
        ["event_id", "user_id", "value", "props"],
        row=F.col("event_id") + 1,
    )
    return grid_to_cells(grid).drop("number_format")


@query
def line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value")
    )
    return clean_lines(lines)


@query
def load_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping_entries(X.mapping_documents(spark, sf_dir), F.col("event_id"))


@query
def default_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many event headers, spelled as the default targets or not, map to each of them."""
    kind = F.col("event_type")
    header = (
        F.when(kind == "signup", "Email")
        .when(kind == "purchase", "Amount")
        .when(kind == "view", F.concat(F.lit("Date"), F.col("user_id") % 2))
        .when(kind == "click", F.initcap(F.lit("name")))
        .otherwise("id")
    )
    found = X.table(spark, sf_dir, "events").select(header.alias("target"))
    counts = found.groupBy("target").agg(F.count(F.lit(1)).alias("headers"))
    # Nothing lies at the first path, so the list of a new project is read; at the other lie the parts' types.
    folder = f"{checkpoint_dir(spark)}/targets-{uuid.uuid4().hex}"
    W.write_lines(X.table(spark, sf_dir, "part").select(F.col("p_type").alias("header")).distinct(), f"{folder}/own")
    lists = [read_targets(spark, f"{folder}/{name}").withColumn("list", F.lit(name)) for name in ("none", "own")]
    both = lists[0].unionByName(lists[1])
    return both.join(counts, "target", "left").fillna(0, ["headers"]).select("list", "pos", "target", "headers")


@query
def target_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = X.conversation_grid(spark, sf_dir)
    return H.target_layout(H.sheet_headers(grid, B.sheet_bounds(grid)), ["file", "sheet"])


# --- cells and headers -----------------------------------------------------


@query
def sheet_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sheet_bounds(landed(spark, sf_dir, X.whole_grid))


@query
def table_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends with a tolerance of two rows on conversations, and of thirty on events in small blocks."""
    small, large = landed(spark, sf_dir, X.conversation_grid), landed(spark, sf_dir, X.event_grid)
    ends = B.table_end(small, B.sheet_bounds(small), 2)
    return ends.unionByName(B.table_end(large, B.sheet_bounds(large), 30, row_block=1024, tasks=_tasks(spark, sf_dir, X.event_grid)))


def _headers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    grid = landed(spark, sf_dir, X.whole_grid)
    bounds = _bounds(spark, sf_dir, X.whole_grid)
    return bounds, H.clean_headers(H.sheet_headers(grid, bounds))


@query
def sheet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _headers(spark, sf_dir)[1].select("file", "sheet", "row", "col", "text")


@query
def clean_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = X.table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("raw"))
    texts = X.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    return pages.union(texts).select("kind", "id", clean_header(F.col("raw")).alias("header"))


@query
def header_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = stored(_headers(spark, sf_dir)[1])
    marked = H.mark_first_seen(headers, H.header_provenance(headers))
    return marked.select("file", "sheet", "col", "header", "class", "is_new")


@query
def scan_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.scanned_headers(_headers(spark, sf_dir)[1])


@query
def header_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.header_provenance(_headers(spark, sf_dir)[1])


@query
def scan_stats_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sheet_scan_stats(*_headers(spark, sf_dir))


@query
def scan_stats_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.file_scan_stats(scan_stats_sheet(spark, sf_dir))


@query
def scan_stats_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds, headers = _headers(spark, sf_dir)
    files = H.file_scan_stats(H.sheet_scan_stats(bounds, headers))
    return H.total_scan_stats(files, H.header_provenance(headers))


@query
def invalid_header_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sheets_without_valid_headers(scan_stats_sheet(spark, sf_dir))


@query
def cell_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = (F.col("l_partkey") * 7 % 16384 + 1).cast("int")
    places = X.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 1).alias("row"), col.alias("col")).distinct()
    return places.select("row", "col", column_letter(F.col("col")).alias("letter"), cell_ref(F.col("row"), F.col("col")).alias("ref"))


@query
def suppress_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formula cells and copied cells per column of the order sheets."""
    cells = grid_to_cells(X.order_grid(spark, sf_dir))
    value = F.col("value")
    return cells.groupBy("col").agg(
        F.count_if(is_formula(value)).alias("formulas"),
        F.count(suppress_formula(value)).alias("kept"),
    )


# --- mapping ---------------------------------------------------------------


@query
def normalize_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.normalize_mapping(X.event_mapping(spark, sf_dir))


@query
def mapping_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entries per event, a header each, written as one document, read and normalised."""
    number = F.col("event_id")
    entries = X.table(spark, sf_dir, "events").select(number, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("kind"))
    ignored = number % 5 == 0
    entries = entries.select(
        F.concat("kind", F.lit(" \"h"), number).alias("scanned"),
        F.when(~ignored, F.concat(F.lit("T"), number % 8)).alias("target"),
        ignored.alias("is_ignored"),
    )
    path = f"{checkpoint_dir(spark)}/mapping-{uuid.uuid4().hex}"
    W.write_mapping(entries, path)
    return M.normalize_mapping(read_mapping(spark, path))


def _part_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.normalize_mapping(X.part_mapping(spark, sf_dir))


@query
def auto_map_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = X.table(spark, sf_dir, "part").select(F.explode(F.array("p_name", "p_type")).alias("header"))
    return M.auto_map_exact(scanned, _part_decisions(spark, sf_dir), X.name_targets(spark, sf_dir))


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions for headers counted in threes, targets named in fives, suggestions by customer."""
    events = X.table(spark, sf_dir, "events")
    normalized = M.normalize_mapping(X.event_mapping(spark, sf_dir, step=3))
    scanned = events.select(F.concat(F.lit("h"), "user_id").alias("header"))
    targets = events.select(F.concat(F.lit("h"), F.col("user_id") * 5).alias("target"))
    suggested = X.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("h"), "c_custkey").alias("scanned"), F.concat(F.lit("T"), F.col("c_custkey") % 8).alias("target")
    )
    return M.merge_mapping(normalized, M.auto_map_exact(scanned, normalized, targets), suggested)


@query
def merge_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session(spark, sf_dir)


@query
def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = X.table(spark, sf_dir, "customer").select(F.concat(F.lit("h"), "c_custkey").alias("header"))
    return M.mapping_coverage(lines, _session(spark, sf_dir))


@query
def mapping_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = X.table(spark, sf_dir, "events").select(F.concat(F.lit("T"), F.col("event_id") % 10).alias("target"))
    return M.mapping_fan_in(normalize_mapping(spark, sf_dir), targets)


@query
def unmapped_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unmapped_headers(X.part_lines(spark, sf_dir), X.part_mapping(spark, sf_dir))


@query
def unmapped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.unmapped_counts(X.part_lines(spark, sf_dir), X.part_mapping(spark, sf_dir))


@query
def append_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = X.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_type").alias("target"))
    customers = X.table(spark, sf_dir, "customer")
    found = customers.select(
        F.col("c_custkey").alias("col"),
        F.when(F.col("c_custkey") % 4 == 0, "SMALL").otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit("\t"))).alias("text"),
    )
    return M.append_targets(existing, found)


# --- decisions -------------------------------------------------------------


@query
def decision_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.fold_decisions(X.decision_log(spark, sf_dir))


@query
def decision_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log as a stream of several batches in no order, its states kept by the stream."""
    path = f"{checkpoint_dir(spark)}/decisions-{uuid.uuid4().hex}"
    X.decision_log(spark, sf_dir).repartition(4, "seq").write.parquet(f"{path}/log")
    log = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/log")
    run = keep_decisions(log, path).option("checkpointLocation", f"{path}/progress")
    run.trigger(availableNow=True).start().awaitTermination()
    return current_states(spark, path)


@query
def saved_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions after an earlier stored mapping."""
    before = D.mapping_as_log(normalize_mapping(spark, sf_dir))
    log = X.decision_log(spark, sf_dir, step=2)
    return D.saved_mapping(D.fold_decisions(before.unionByName(log)))


@query
def review_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.review_worklist(unmapped_headers(spark, sf_dir), cursor=100)


# --- suggestions -----------------------------------------------------------


@query
def suggestion_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.suggestion_batches(X.sized_names(spark, sf_dir))


@query
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.batch_requests(suggestion_batches(spark, sf_dir), X.targets(spark, sf_dir))


@query
def parse_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.parse_suggestions(X.replies(spark, sf_dir))


@query
def accepted_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.accept_suggestions(parse_suggestions(spark, sf_dir))


@query
def apply_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = X.table(spark, sf_dir, "part").select(F.col("p_type").alias("target"))
    targets = kinds.replace("PROMO", "OTHER", "target")
    return S.apply_suggestions(accepted_suggestions(spark, sf_dir), _part_decisions(spark, sf_dir), targets)


@query
def suggest_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.suggest_similar(X.noisy_names(spark, sf_dir), X.name_targets(spark, sf_dir))
    return found.withColumn("confidence", F.round("confidence", 6))


def _length_model():
    """A stand-in for a model: how alike two names are in length."""

    def score(names, wanted):
        one, two = names.str.len(), wanted.str.len()
        return one.where(one < two, two) / one.where(one > two, two)

    return score


@query
def suggest_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best target by a user's function over blocked candidate pairs."""
    found = S.suggest_scored(X.noisy_names(spark, sf_dir), X.name_targets(spark, sf_dir), _length_model, candidates=0.6)
    return found.withColumn("confidence", F.round("confidence", 6))


@query
def suggestion_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = S.suggestion_batches(X.scanned(spark, sf_dir)).drop("batch")
    return S.suggestion_audit(sent, accepted_suggestions(spark, sf_dir))


# --- formatting ------------------------------------------------------------


@dataclass(frozen=True)
class Orders:
    """The order sheets with everything formatting needs."""

    grid: DataFrame
    bounds: DataFrame
    headers: DataFrame
    applicable: DataFrame
    plans: DataFrame
    layout: Fm.Layout


def _orders(spark: SparkSession, sf_dir: str, layout: Fm.Layout = Fm.Layout(X.LAYOUT)) -> Orders:
    return _planned(spark, sf_dir, X.order_grid, layout)


def _planned(spark: SparkSession, sf_dir: str, make: Query, layout: Fm.Layout) -> Orders:
    grid = landed(spark, sf_dir, make)
    bounds = _bounds(spark, sf_dir, make)
    headers = H.clean_headers(H.sheet_headers(grid, bounds))
    normalized = M.normalize_mapping(X.order_mapping(spark))
    named = H.input_headers(headers, tasks=_tasks(spark, sf_dir, make))
    applicable = Fm.applicable_mappings(named, normalized, layout)
    return Orders(grid, bounds, headers, applicable, Fm.sheet_plans(bounds, applicable, layout), layout)


def _ready(spark: SparkSession, sf_dir: str, layout: Fm.Layout = Fm.Layout(X.LAYOUT)) -> Orders:
    """The order sheets with their plans stored, as a run of several steps has them."""
    o = _orders(spark, sf_dir, layout)
    return replace(o, plans=stored(o.plans))


@query
def applicable_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).applicable


@query
def uncovered_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return Fm.uncovered_targets(o.bounds, o.applicable, o.layout)


@query
def format_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned rows, nothing dropped."""
    o = _ready(spark, sf_dir)
    return Fm.as_columns(Fm.project_values(o.grid, o.plans, o.layout).drop("block"), o.layout)


@query
def drop_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns only, so that thousands of rows hold nothing; numbered anew."""
    o = _ready(spark, sf_dir, Fm.Layout(("supplier_id", "flag")))
    return Fm.format_sheets(o.grid, o.plans, o.layout)


@query
def format_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _ready(spark, sf_dir)
    return Fm.format_sheets(o.grid, o.plans, o.layout)


@query
def format_projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As format_all, from the one stored projection that the job takes types and summary from too."""
    o = _ready(spark, sf_dir)
    projected = stored(Fm.project_once(o.grid, o.plans, o.layout))
    return Fm.format_projected(projected, o.plans, o.layout)


@query
def fill_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row down to the extent, blank rows included."""
    o = _ready(spark, sf_dir)
    return Fm.format_sheets(o.grid, o.plans, o.layout, drop_empty=False)


@query
def format_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = B.sheet_bounds(X.whole_grid(spark, sf_dir))
    return Fm.format_extent(bounds, Fm.Layout(X.LAYOUT, header_row=2), template_rows=7)


@query
def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _ready(spark, sf_dir)
    profile = T.column_profile(Fm.project_cells(o.grid, o.plans, o.layout), o.layout)
    rows = Fm.project_values(o.grid, o.plans, o.layout).drop("block")
    return T.typed_rows(Fm.as_columns(rows, o.layout), T.column_types(T.column_formats(profile)))


@query
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, times, large whole numbers, truth values and amounts in the types that hold them."""
    layout = Fm.Layout(X.TYPED)
    names = spark.createDataFrame([(k, n, n, False) for k, n in enumerate(X.TYPED)], "ord int, scanned string, target string, is_ignored boolean")
    grid = landed(spark, sf_dir, X.typed_grid)
    bounds = stored(B.sheet_bounds(grid))
    headers = H.clean_headers(H.sheet_headers(grid, bounds))
    applicable = Fm.applicable_mappings(H.input_headers(headers), M.normalize_mapping(names), layout)
    plans = stored(Fm.sheet_plans(bounds, applicable, layout))
    types = T.column_types(T.column_formats(T.column_profile(Fm.project_cells(grid, plans, layout), layout)))
    rows = T.typed_rows(Fm.format_sheets(grid, plans, layout, renumber=False), types)
    # Amounts beyond a double come back from their decimal type as the text they were.
    return rows.withColumns({"moment": F.date_format("moment", "yyyy-MM-dd HH:mm:ss"), "exact": F.col("exact").cast("string")})


@query
def column_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _ready(spark, sf_dir)
    return T.column_formats(T.column_profile(Fm.project_cells(o.grid, o.plans, o.layout), o.layout))


@query
def template_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = X.template_grid(spark, sf_dir)
    bounds = B.sheet_bounds(template)
    layout = Fm.Layout.of(H.target_layout(H.sheet_headers(template, bounds)), header_row=2)
    o = _ready(spark, sf_dir, layout)
    rows = Fm.format_sheets(o.grid, o.plans, layout, renumber=False)
    return Fm.template_overlay(rows, template, o.bounds, layout)


# --- reports and sinks -----------------------------------------------------


@query
def format_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _ready(spark, sf_dir, Fm.Layout(("supplier_id", "flag", "note")))
    return R.format_summary(Fm.project_cells(o.grid, o.plans, o.layout), o.plans, o.layout)


@query
def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _planned(spark, sf_dir, X.whole_grid, Fm.Layout(X.LAYOUT))
    return R.sheet_rejects(H.sheet_scan_stats(o.bounds, o.headers), o.plans)


@query
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _planned(spark, sf_dir, X.whole_grid, Fm.Layout(X.LAYOUT))
    found = R.sheet_rejects(H.sheet_scan_stats(o.bounds, o.headers), o.plans)
    return R.batch_summary(o.bounds, found)


@query
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.output_names(B.sheet_bounds(X.whole_grid(spark, sf_dir)))


@query
def sink_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formatted rows written and read back."""
    rows = format_all(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/sheets-{uuid.uuid4().hex}"
    W.write_sheets(rows, path, folder_per_sheet=False)
    return W.read_sheets(spark, path, rows.schema)


@query
def header_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted header list written as lines and read with its places."""
    path = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    W.write_lines(scan_headers(spark, sf_dir), path)
    return read_lines(spark, path)


@query
def unmapped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers without an entry, written as a report and read back."""
    rows = unmapped_headers(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    W.write_report(rows, path)
    return spark.read.schema(rows.schema).options(**W.CSV_OPTIONS).csv(path)


@query
def stats_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File statistics of two runs in one table."""
    stats = stored(scan_stats_file(spark, sf_dir))
    path = f"{checkpoint_dir(spark)}/stats-{uuid.uuid4().hex}"
    for run in ("first", "second", "first"):
        W.append_stats(stats, path, run)
    return spark.read.parquet(path)


@query
def published_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File statistics of two published runs; one is repeated, and one attempt fails after it has written."""
    stats = stored(scan_stats_file(spark, sf_dir))
    path = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"

    def job(folder: str) -> None:
        W.write_report(stats, f"{folder}/file_stats", "parquet")

    def failing(folder: str) -> None:
        W.write_report(stats.limit(1), f"{folder}/file_stats", "parquet")
        raise RuntimeError("lost")

    for run in ("first", "second", "first"):
        Pb.publish(spark, path, run, job)
    try:
        Pb.publish(spark, path, "second", failing)
    except RuntimeError:
        pass
    return Pb.published(spark, path, "file_stats", stats.schema)


@query
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unique_names(stored(B.sheet_bounds(landed(spark, sf_dir, X.whole_grid))))


def _conversation_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    layout = Fm.Layout(("speaker", "words"))
    grid = landed(spark, sf_dir, X.conversation_grid)
    bounds = stored(B.sheet_bounds(grid))
    headers = H.clean_headers(H.sheet_headers(grid, bounds))
    names = [(0, "Role", "speaker", False), (1, "Text (note)", "words", False), (2, "Text", "words", False)]
    mapping = spark.createDataFrame(names, "ord int, scanned string, target string, is_ignored boolean")
    applicable = Fm.applicable_mappings(H.input_headers(headers), M.normalize_mapping(mapping), layout)
    plans = stored(Fm.sheet_plans(bounds, applicable, layout))
    return bounds, Fm.format_sheets(grid, plans, layout)


@query
def sheets_by_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation sheets formatted, written to a folder per sheet and read back."""
    _, rows = _conversation_rows(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/sheets-{uuid.uuid4().hex}"
    W.write_sheets(rows, path)
    return W.read_sheets(spark, path, rows.schema)


@query
def sheets_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheets in folders by output name."""
    bounds, rows = _conversation_rows(spark, sf_dir)
    path = f"{checkpoint_dir(spark)}/sheets-{uuid.uuid4().hex}"
    names = stored(R.unique_names(bounds))
    W.write_named_sheets(rows, names, path)
    return W.read_sheets(spark, path, rows.join(names, ["file", "sheet"]).schema)
