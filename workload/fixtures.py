"""Sheets, mappings, logs and replies derived from the test tables.

The SQL twins in ``oracles`` build the same inputs as long cells. No input
needs a window or collects a group: row numbers come from keys, and rows which
would share a place are merged by an aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrecover.grid import CELL_TYPE, cell
from tabrecover.sources.files import filesystem
from workload.xlsx import Cell, cut_part, number_rows, texts_of, workbook

LAYOUT = ("part_id", "supplier_id", "qty", "flag", "note")

# Stored mapping for the order sheets: a header listed twice (the last entry
# wins), one ignored, one both mapped and ignored, one without a target.
ORDER_MAPPING = [
    (0, "Part", "part_id", False),
    (1, "part no", "part_id", False),
    (2, "Item", "part_id", False),
    (3, "Supplier", "supplier_id", False),
    (4, "Vendor", "vendor", False),
    (5, "Vendor", "supplier_id", False),
    (6, "Qty", "qty", False),
    (7, "Quantity", "qty", False),
    (8, "QTY", "", True),
    (9, "Flag", "flag", False),
    (10, "Return", "flag", False),
    (11, "Return", "", True),
    (12, "Old", "", False),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _row(number: Column | int, *cells: Column) -> list[Column]:
    number = F.lit(number) if isinstance(number, int) else number
    return [number.cast("bigint").alias("row"), F.array(*cells).alias("cells")]


def text(value: str) -> Column:
    return cell(F.lit(value))


def conversation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per conversation: up to two title rows, a header with tag, line break and
    spaces, and a gap of up to three rows before turn 4."""
    turns = table(spark, sf_dir, "conversations")
    titles = F.col("conv_id") % 3
    turns = turns.select(
        F.concat(F.lit("book"), F.col("conv_id") % 10).alias("file"),
        F.col("conv_id").alias("sheet_idx"),
        F.col("conv_id").cast("string").alias("sheet"),
        titles.alias("titles"),
        (titles + 2 + F.col("turn") + F.when(F.col("turn") >= 4, F.col("conv_id") % 4).otherwise(0)).alias("at"),
        "role",
        "text",
        F.when(F.col("turn") % 4 != 3, F.col("turn")).alias("number"),
    )
    keys = ["file", "sheet_idx", "sheet"]
    sheets = turns.select(*keys, "titles").distinct()
    parts = [
        turns.select(*keys, *_row(F.col("at"), cell(F.col("role")), cell(F.col("text")), cell(F.col("number"), "n"))),
        sheets.select(
            *keys, *_row(F.col("titles") + 1, text("<b>Role</b>"), text("Text\n(note)"), text(" Turn   No "))
        ),
        sheets.filter("titles >= 1").select(*keys, *_row(1, text("Export"))),
        sheets.filter("titles >= 2").select(*keys, *_row(2, text("  "))),
    ]
    return _union(parts)


def order_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per order, one row per line number: four header spellings, one layout with
    a header twice, formula texts, whitespace cells."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("part"),
        F.max("l_suppkey").alias("supplier"),
        F.sum("l_quantity").cast("bigint").alias("quantity"),
        F.char(F.max(F.ascii("l_returnflag"))).alias("flag"),
    )
    keys = [
        F.concat(F.lit("in/"), key % 3, F.lit("/f"), key % 50, F.lit(".xlsx")).alias("file"),
        F.floor(key / 150).alias("sheet_idx"),
        F.concat(F.lit("S"), F.floor(key / 150)).alias("sheet"),
    ]
    formula = F.col("supplier") % 9 == 0
    body = lines.select(
        *keys,
        *_row(
            F.col("l_linenumber") + 1,
            cell(F.col("part"), "n"),
            F.when(formula, text("=A1")).otherwise(cell(F.col("supplier"), "n", "@")),
            cell(F.col("quantity"), "n", "0.00"),
            F.when(F.col("flag") == "N", text(" ")).otherwise(cell(F.col("flag"), "s", "@")),
        ),
    )

    def spelled(*by_kind: str) -> Column:
        spelling = F.get(F.array(*[F.lit(s) for s in by_kind]), (key % 4).cast("int"))
        return cell(spelling)

    heads = lines.select("l_orderkey").distinct()
    header = heads.select(
        *keys,
        *_row(
            1,
            spelled("Part", "part no", "<b>Part</b>", "Item"),
            spelled("Supplier", "Vendor", "Supplier", "Supplier  Name"),
            spelled("Qty", "Quantity", "Flag", "QTY"),
            spelled("Flag", "Flag", "Flag", "Return"),
        ),
    )
    return _union([body, header])


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the event sheets before their cells are made: keys, row, kind (0 event, 1 title, 2 header) and an event's columns."""
    events = table(spark, sf_dir, "events")
    main = F.col("event_id") % 3 == 0
    events = events.select(
        F.lit("log").alias("file"),
        F.when(main, 0).otherwise(F.col("user_id") + 1).cast("bigint").alias("sheet_idx"),
        F.when(main, "main").otherwise(F.concat(F.lit("user"), "user_id")).alias("sheet"),
        "event_id",
        "user_id",
        "event_type",
        F.when(~(F.col("event_id") % 4096).between(2000, 2099), F.col("value")).alias("value"),
    )
    keys = ["file", "sheet_idx", "sheet"]
    sheets = events.select(*keys).distinct()
    body = events.select(*keys, (F.col("event_id") + 3).cast("bigint").alias("row"), F.lit(0).alias("kind"), "user_id", "event_type", "value")
    heads = [sheets.select(*keys, F.lit(n).cast("bigint").alias("row"), F.lit(n).alias("kind")) for n in (1, 2)]
    return body.unionByName(_union(heads), allowMissingColumns=True)


def event_cells(rows: DataFrame) -> DataFrame:
    """The grid rows of ``event_rows``; a block column stays."""
    cells = (
        F.when(F.col("kind") == 1, F.array(text("Activity")))
        .when(F.col("kind") == 2, F.array(text("<i>User</i>"), text("Kind\u00a0 of"), text("<br/>"), text("Value\n(unit)")))
        .otherwise(
            F.array(
                cell(F.col("user_id"), "n"),
                cell(F.col("event_type")),
                text(" \t"),
                cell(F.col("value"), "n", "0.00"),
            )
        )
    )
    return rows.select("file", "sheet_idx", "sheet", "row", cells.alias("cells"), *[c for c in rows.columns if c == "block"])


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet with a third of all events and one per user; blank runs in the last column."""
    return event_cells(event_rows(spark, sf_dir))


#: Grids that are dealt out as narrow rows, and what makes cells of those.
NARROW = {"event_grid": (event_rows, event_cells)}


def blank_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets with nothing but whitespace, one per customer."""
    return table(spark, sf_dir, "customer").select(
        F.lit("blank").alias("file"),
        F.col("c_custkey").alias("sheet_idx"),
        F.col("c_custkey").cast("string").alias("sheet"),
        *_row(1, text("  "), text("\t")),
    )


#: The tables whose rows become the rows of each grid.
SOURCES = {
    "conversation_grid": ["conversations"],
    "order_grid": ["lineitem"],
    "event_grid": ["events"],
    "typed_grid": ["events"],
    "whole_grid": ["conversations", "lineitem", "events", "customer"],
}


def whole_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sheets of the fixtures."""
    makers = [conversation_grid, order_grid, event_grid, blank_grid]
    return _union([make(spark, sf_dir) for make in makers])


def customer_workbooks(spark: SparkSession, sf_dir: str, folder: str) -> int:
    """Write a workbook with two sheets per 500 customers; gives their number.

    The customer key is unique, so a workbook has 500 rows at most.
    """
    customers = table(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / 500).alias("book"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment"
    )

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        path = f"{folder}/book{key[0].as_py()}.xlsx"
        sheets: dict[str, dict] = {}
        for r in rows.to_pylist():
            number = r["c_custkey"]
            head = {1: Cell("s", "Number"), 2: Cell("inline", "<b>Name</b>"), 4: Cell("s", "Balance"), 5: Cell("s", "Since")}
            sheet = sheets.setdefault(f"part {number % 2}", {1: head})
            sheet[number % 500 // 2 + 2] = {
                1: Cell("n", number),
                2: Cell("s" if number % 3 else "inline", r["c_name"]),
                3: Cell("empty", style=4),
                4: Cell("n", repr(r["c_acctbal"]), 1, formula="1+1"),
                5: Cell("n", 40000 + number % 1000, 2),
                6: Cell("b", number % 2),
            }
        fs, inner = filesystem(path)
        with fs.open_output_stream(inner) as out:
            out.write(workbook(sorted(sheets.items())))
        return pa.table({"file": [path]})

    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    return customers.groupBy("book").applyInArrow(write, "file string").count()


#: Orders whose lines make up a workbook, some 7,000 lines at most.
BOOK_ORDERS = 1000


def line_workbooks(spark: SparkSession, sf_dir: str, folder: str) -> int:
    """Write a workbook of ten columns per block of orders, with all their lines; gives their number.

    By number modulo five there is a broken file beside a book: one that is no zip (0), a copy of the
    book with its sheet cut off near the end (1), an empty one (3). The book itself has a
    number nobody can read in every thousandth line if the remainder is 2.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / BOOK_ORDERS).alias("book"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"
    )

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        number = key[0].as_py()
        head = {1: {c: Cell("s", f"column {c}") for c in range(1, 11)}}
        names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
        values = [texts_of(rows.column(c)) for c in names]
        again = [*values]
        if number % 5 == 2:
            bad = pa.array(np.arange(1, rows.num_rows + 1) % 1000 == 0)
            values[3], again[3] = pc.if_else(bad, "1x2", values[3]), pc.if_else(bad, "1", values[3])
        data = workbook([("lines", head)], below={"lines": number_rows(2, [*values, *again])})
        files = {f"lines{number}.xlsx": data}
        if number % 5 == 0:
            files[f"nozip{number}.xlsx"] = b"no workbook"
        elif number % 5 == 1:
            files[f"cut{number}.xlsx"] = cut_part(data, "xl/worksheets/sheet1.xml", 0.95)
        elif number % 5 == 3:
            files[f"empty{number}.xlsx"] = b""
        for name, content in files.items():
            fs, inner = filesystem(f"{folder}/{name}")
            with fs.open_output_stream(inner) as out:
                out.write(content)
        return pa.table({"file": list(files)})

    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    return lines.groupBy("book").applyInArrow(write, "file string").count()


#: Parts of a workbook of parts.
BOOK_PARTS = 100


def part_workbooks(spark: SparkSession, sf_dir: str, folder: str, again: bool) -> int:
    """Write a workbook per block of parts into two folders, a and (every fourth book) b; gives their number.

    A second time (``again``) only what changes is written: every third book of folder a with other names and
    another header, and a copy of every fifth as a new book.
    """
    parts = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / BOOK_PARTS).alias("book"), "p_partkey", "p_name", "p_size")
    number = F.col("book")
    if again:
        parts = parts.filter((number % 4 != 3) & (number % 3 == 1) | (number % 5 == 0))

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        book = key[0].as_py()

        def written(name: str, new: bool) -> None:
            sheet = {1: {c: Cell("s", t) for c, t in enumerate(["key", "title" if new else "name", "size "], 1)}}
            for r in rows.to_pylist():
                text = r["p_name"].upper() if new else r["p_name"]
                sheet[r["p_partkey"] % BOOK_PARTS + 2] = {1: Cell("n", r["p_partkey"]), 2: Cell("s", text), 3: Cell("n", r["p_size"])}
            fs, inner = filesystem(f"{folder}/{name}")
            with fs.open_output_stream(inner) as out:
                out.write(workbook([("parts", sheet)]))

        if not again:
            written(f"{'b' if book % 4 == 3 else 'a'}/book{book}.xlsx", False)
        elif book % 4 != 3 and book % 3 == 1:
            written(f"a/book{book}.xlsx", True)
        if again and book % 5 == 0:
            written(f"a/copy{book}.xlsx", False)
        return pa.table({"book": [book]})

    for part in ("a", "b"):
        fs, inner = filesystem(f"{folder}/{part}")
        fs.create_dir(inner, recursive=True)
    return parts.groupBy("book").applyInArrow(write, "book long").count()


def part_files(spark: SparkSession, sf_dir: str, folder: str) -> int:
    """Write a file per part, of as many bytes as its key modulo 49; every tenth is a lock file."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")

    def write(batches):
        for batch in batches:
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                deep = f"{folder}/a{key % 3}/b{size % 7}"
                fs, inner = filesystem(deep)
                fs.create_dir(inner, recursive=True)
                lock = "~$" if key % 10 == 0 else ""
                with fs.open_output_stream(f"{inner}/{lock}part{key}.{'XLSX' if key % 2 else 'xlsx'}") as out:
                    out.write(b"x" * (key % 49))
            yield batch.select(["p_partkey"])

    return parts.mapInArrow(write, "p_partkey bigint").count()


def typed_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per kind of event with dates, times of a day, whole numbers above 2^53, truth values and amounts."""
    events = table(spark, sf_dir, "events")
    keys = [
        F.lit("typed").alias("file"),
        F.length("event_type").cast("bigint").alias("sheet_idx"),
        F.col("event_type").alias("sheet"),
    ]
    number = F.col("event_id")
    hour = F.lpad((number % 24).cast("string"), 2, "0")
    day = F.lpad((number % 28 + 1).cast("string"), 2, "0")
    body = events.select(
        *keys,
        *_row(
            number + 2,
            cell(F.concat(F.lit("2024-02-"), day, F.lit(" "), hour, F.lit(":30:00")), "d", "yyyy-mm-dd"),
            cell(F.concat(hour, F.lit(":15:00")), "d", "h:mm"),
            cell(number + F.lit(9_007_199_254_740_993), "n", "0"),
            cell(F.when(number % 2 == 0, "TRUE").otherwise("FALSE"), "b"),
            cell((number / 8).cast("decimal(20,3)"), "n", "0.00"),
            cell(F.concat((number + F.lit(12_345_678_901_234_567)).cast("string"), F.lit(".8"), number % 10), "n", "0.00"),
        ),
    )
    heads = events.select(*keys).distinct()
    header = heads.select("file", "sheet_idx", "sheet", *_row(1, *[text(c) for c in TYPED]))
    return _union([body, header])


TYPED = ("moment", "clock", "number", "truth", "amount", "exact")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def order_mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ORDER_MAPPING, "ord int, scanned string, target string, is_ignored boolean")


def event_mapping(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    """A long stored mapping: an entry per event, many per header, some ignored or empty.

    ``step`` spreads the header numbers, so that they meet a part of other headers.
    """
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"),
        F.concat(F.lit("h"), F.col("user_id") * step).alias("scanned"),
        F.when(F.col("event_type") == "signup", "").otherwise(F.concat(F.lit("T"), F.col("event_id") % 8)).alias("target"),
        F.when((F.col("event_type") == "error") & (F.col("event_id") % 40 == 3), True)
        .when(F.col("event_id") % 3 != 0, False)
        .alias("is_ignored"),
    )


def mapping_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON mapping document with two entries per event."""
    first = F.struct(
        F.concat(F.lit("h"), "user_id").alias("scanned_column"),
        F.concat(F.lit("T"), F.col("event_id") % 8).alias("target_column"),
        (F.col("event_type") == "error").alias("is_ignored"),
    )
    second = F.struct(
        F.col("event_type").alias("scanned_column"),
        F.lit("kind").alias("target_column"),
        F.lit(None).cast("boolean").alias("is_ignored"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id", F.to_json(F.struct(F.array(first, second).alias("mappings"))).alias("text")
    )


def decision_log(spark: SparkSession, sf_dir: str, step: int = 1) -> DataFrame:
    """A log with an entry per event; ``step`` as for ``event_mapping``."""
    maps = F.col("event_type").isin("click", "view", "purchase")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("h"), F.col("user_id") * step).alias("scanned"),
        F.col("event_id").alias("seq"),
        F.when(maps, "map").otherwise("toggle_ignore").alias("action"),
        F.when(maps, F.concat(F.lit("T"), F.col("event_id") % 8)).alias("target"),
    )


def part_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned lines with many copies: pos, header."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("header"))


def part_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry per part, under its name for rings and hot things, under an old one for others."""
    current = F.expr("p_name like '%ring' or p_name like 'hot %'")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.when(current, F.col("p_name")).otherwise(F.concat(F.lit("old "), "p_name")).alias("scanned"),
        F.col("p_type").alias("target"),
        (F.col("p_size") == 7).alias("is_ignored"),
    )


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("header")).union(part.select("p_type")).distinct()


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = table(spark, sf_dir, "part").select(F.col("p_type").alias("target"))
    return kinds.union(table(spark, sf_dir, "region").select("r_name")).distinct()


def sized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with sizes, a few thousand distinct headers."""
    part = table(spark, sf_dir, "part")
    return part.select(F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("header")).distinct()


def noisy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in other spellings."""
    part = table(spark, sf_dir, "part")
    name = F.col("p_name")
    spellings = F.array(
        F.upper(F.replace(name, F.lit(" "), F.lit("_"))),
        F.concat(F.lit("my "), name),
        F.replace(name, F.lit("i"), F.lit("y")),
        F.concat_ws(" ", name, F.col("p_size").cast("string")),
    )
    return part.select(F.explode(spellings).alias("header")).distinct()


def name_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("target"))
    return names.union(targets(spark, sf_dir)).distinct()


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply per part: one suggestion line, every second one below a heading."""
    size, key = F.col("p_size"), F.col("p_partkey")
    target = F.when(size % 7 == 0, "NO_MATCH").otherwise(F.col("p_type"))
    score = F.concat(F.lit("0."), F.lpad((key % 100).cast("string"), 2, "0"), F.when(size % 5 == 0, "x").otherwise(""))
    line = (
        F.when(size % 11 == 0, F.concat_ws("|", "p_name", "p_type"))
        .when(size % 13 == 0, "ScannedColumn|TargetColumn|Confidence")
        .otherwise(F.concat(F.lit(" "), "p_name", F.lit(" | "), target, F.lit(" | "), score))
    )
    headed = F.concat(F.lit("ScannedColumn|TargetColumn|Confidence\n"), line, F.lit("\n"))
    return table(spark, sf_dir, "part").select(
        key.alias("reply"), F.when(key % 2 == 0, headed).otherwise(line).alias("text")
    )


def template_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template: a title, the header row with one nameless column, and below it a region
    name or a formula in the nameless column."""
    region = table(spark, sf_dir, "region")
    keys = [F.lit("template").alias("file"), F.lit(0).cast("bigint").alias("sheet_idx"), F.lit("Sheet1").alias("sheet")]
    note = F.when(F.col("r_regionkey") % 2 == 0, cell(F.col("r_name"))).otherwise(text("=B1"))
    old = text("old")
    none = F.lit(None).cast(CELL_TYPE)
    first = region.agg(F.min("r_regionkey"))
    return _union([
        first.select(*keys, *_row(1, text("Standard layout"))),
        first.select(
            *keys,
            *_row(2, text("part_id"), none, text(" supplier_id "), text("flag"), text("note"), text("flag")),
        ),
        region.select(*keys, *_row(F.col("r_regionkey") + 3, old, note)),
    ])

