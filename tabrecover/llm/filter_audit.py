"""What each quality filter does in every order the filters could be applied in.

A row's failures are bits of a mask. Rows with equal part, mask and label marks
are alike, so a table of any size comes down to one count per part and mask.
Each of these cells is then folded across the array of all orders with ``aggregate``
and ``transform`` (five filters: 120 orders of 5 steps, 600 weighted structs), and
the structs of a part's cells are added up element by element. The order array is
a literal of the plan, which goes out to the tasks with it.

The repeat filter looks at the whole table: texts meet by their SHA-256, never
themselves, and rows of one text and alike otherwise are counted together
before they are sent, so a text or an id that a third of the rows share is no large group.

Defined results: null texts are empty, null parts and empty parts are one; a row without an id
fails no repeat filter and makes no other row fail it, and has no labels; rows of one id and
text are not smaller than each other; an id with several label rows is good (toxic) if
one of them says so; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrecover.llm.common import stored
from tabrecover.plans.joins import key_counts, salted_join

_SPACE = r"[\x20\x09-\x0D]+"
_MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

#: Failure of a text, from the text and its words.
Condition = Callable[[Column, Column], Column]

FILTERS: dict[str, Condition] = {
    "A": lambda text, words: F.size(words) < 200,
    "B": lambda text, words: 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
    "C": lambda text, words: 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
    "D": lambda text, words: text.rlike("[#$%&*|]"),
}
#: Name of the filter that rows fail whose text a smaller id has.
REPEAT = "E"


def facts(docs: DataFrame, filters: Mapping[str, Condition], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``doc_id, part, digest, mask`` of every row: failures of its own text, one bit for each filter."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    bits = [F.when(fails(F.col("text"), F.col("words")), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = sum(bits, F.lit(0)).cast("int")
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``good, toxic`` from the label rows of each id."""
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.filter(F.col("doc_id").isNotNull() & (F.col("good") | F.col("toxic")))
    marks = marks.groupBy("doc_id").agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")))
    named = rows.filter(F.col("doc_id").isNotNull())
    found = salted_join(named, marks, ["doc_id"], "left", counts=key_counts(named, ["doc_id"]))
    found = found.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    nameless = rows.filter(F.col("doc_id").isNull()).withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return found.unionByName(nameless)


def cells(rows: DataFrame, bit: int) -> DataFrame:
    """``part, mask, n, n_good, n_toxic``, with ``bit`` set for rows whose text a smaller id has."""
    alike = ["digest", "part", "mask", "good", "toxic"]
    counted = rows.groupBy(*alike, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    counted = stored(
        counted.groupBy(*alike).agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
            F.min("doc_id").alias("least"),
            F.min_by("n", "doc_id").alias("n_least"),
        )
    )
    firsts = counted.groupBy("digest").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("groups"))
    found = salted_join(
        counted, firsts.select("digest", "first"), ["digest"], counts=firsts.select("digest", F.col("groups").alias("n"))
    )
    passing = F.col("nameless") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), passing.alias("n")),
        F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - passing).alias("n")),
    )
    found = found.select("part", "good", "toxic", F.explode(both).alias("cell")).select("part", "good", "toxic", "cell.*")
    found = found.filter(F.col("n") > 0).groupBy("part", "mask")
    return found.agg(
        F.sum("n").alias("n"),
        *(F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0)).alias(f"n_{c}") for c in ("good", "toxic")),
    )


def _zero() -> Column:
    return F.struct(*(F.lit(0).cast("long").alias(m) for m in _MEASURES))


def _steps(cell: Column, order: Column) -> Column:
    """One struct per step of an order for the rows of a cell, by a fold that carries whether they are still there."""

    def step(state: Column, place: Column) -> Column:
        fails = F.call_function("shiftright", cell["mask"], place).bitwiseAND(1) == 1
        alone = cell["mask"] == F.call_function("shiftleft", F.lit(1), place)
        there = state["there"]

        def weight(when: Column, count: Column) -> Column:
            return F.when(when, count).otherwise(F.lit(0).cast("long"))

        made = F.struct(
            weight(there & ~fails, cell["n"]).alias("kept"),
            weight(there & fails, cell["n"]).alias("removed"),
            weight(~there & fails, cell["n"]).alias("redundant"),
            weight(alone, cell["n"]).alias("unique_fails"),
            weight(there & fails, cell["n_good"]).alias("good_lost"),
            weight(there & fails, cell["n_toxic"]).alias("toxic_lost"),
        )
        return F.struct((there & ~fails).alias("there"), F.array_append(state["made"], made).alias("made"))

    start = F.struct(F.lit(True).alias("there"), F.slice(F.array(_zero()), 1, 0).alias("made"))
    return F.aggregate(order, start, step, lambda state: state["made"])


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Condition] = FILTERS,
    repeat: str = REPEAT,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``kept, removed, redundant`` (failing this step's filter, but removed earlier), ``unique_fails``
    (failing no other filter), ``good_lost, toxic_lost`` count rows of the part;
    ``shapley`` is what the step's filter removes, summed over all orders. ``filters`` are the conditions
    on single texts, ``repeat`` names the filter for texts that a smaller id has; six filters at most, since
    every order is in the result.
    """
    names = [*filters, repeat]
    if len(names) > 6:
        raise ValueError("at most six filters: every order of them is a part of the result")
    places = list(itertools.permutations(range(len(names))))
    orders = F.array(*(F.array(*map(F.lit, p)) for p in places))
    titles = F.lit(["".join(names[i] for i in p) for p in places])
    width = len(names)

    counted = cells(labelled(stored(facts(docs, filters, id_col, text_col, part_col)), labels), 1 << len(filters))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("cells"))

    def added(one: Column, two: Column) -> Column:
        return F.struct(*((one[m] + two[m]).alias(m) for m in _MEASURES))

    def folded(cell: Column) -> Column:
        return F.flatten(F.transform(orders, lambda order: _steps(cell, order)))

    total = F.aggregate(
        F.col("cells"),
        F.array_repeat(_zero(), len(places) * width),
        lambda total, cell: F.zip_with(total, folded(cell), added),
    )
    steps = F.flatten(orders)

    def removed_by(i: Column) -> Column:
        pairs = F.zip_with(F.col("total"), F.col("steps"), lambda t, s: F.when(s == i, t["removed"]).otherwise(0))
        return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, b: a + b)

    found = parts.select("part", total.alias("total"), steps.alias("steps"))
    every = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), removed_by)
    # Sums come before the rows are taken apart, and places are exploded instead of structs, or Spark would work them out anew for every row and once more to see if there are any.
    found = found.withColumn("every", every)
    found = found.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(places) * width - 1))))
    return found.select(
        "part",
        F.get(titles, F.expr(f"at div {width}").cast("int")).alias("filter_order"),
        (F.col("at") % width + 1).cast("int").alias("step"),
        *(F.get("total", F.col("at"))[m].alias(m) for m in _MEASURES),
        F.get("every", F.get("steps", F.col("at"))).alias("shapley"),
    )
