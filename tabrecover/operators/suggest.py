"""Suggested targets for undecided headers: requests, replies, and a scorer on Spark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrecover.functions.text import leading_number, trim_space
from tabrecover.functions.tokens import plain, words
from tabrecover.operators.mapping import decided_headers
from tabrecover.plans.checkpoints import stored
from tabrecover.plans.joins import lookup_join, salted_join
from tabrecover.plans.positions import with_position

# Fixed values of the request and reply format.
ONE_REQUEST_UP_TO = 100
BATCH_SIZE = 50
NO_MATCH = "NO_MATCH"
HEADING = "ScannedColumn|"
MIN_CONFIDENCE = 0.6

#: Targets that a request may list.
MAX_TARGETS = 50_000


def suggestion_batches(headers: DataFrame, order: str = "header") -> DataFrame:
    """Number the headers and their requests: pos, batch (both from 0).

    Up to 100 headers go into one request, more go into requests of 50.
    """
    numbered = with_position(headers, [order])
    if numbered.count() <= ONE_REQUEST_UP_TO:
        return numbered.withColumn("batch", F.lit(0).cast("bigint"))
    return numbered.withColumn("batch", F.floor(F.col("pos") / BATCH_SIZE).cast("bigint"))


def batch_requests(batches: DataFrame, targets: DataFrame) -> DataFrame:
    """Text of each request: batch, headers (their number), request.

    A batch holds at most 100 headers. All targets go into every request, so the
    list is read once and becomes a part of the text; a list of more than ``MAX_TARGETS`` is
    refused, and the caller hands over the part that is to be asked for.
    """
    names = [r.target for r in targets.select("target").orderBy("target").limit(MAX_TARGETS + 1).collect()]
    if len(names) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets for one request: choose those to ask for")
    task = (
        "Match each found column name to the one standard column with the same meaning.\n"
        f"Answer one line per found column: {HEADING}TargetColumn|Confidence\n"
        f"Confidence is between 0 and 1. Without a clear match write {NO_MATCH} as the target."
    )
    wanted = "STANDARD COLUMNS\n" + "\n".join(f"- {name}" for name in names)
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "header"))),
        lambda h: F.concat(F.lit("- "), h["header"]),
    )
    return (
        batches.groupBy("batch")
        .agg(F.count(F.lit(1)).alias("headers"), lines.alias("lines"))
        .select(
            "batch",
            "headers",
            F.concat_ws(
                "\n\n",
                F.lit(task),
                F.concat(F.lit("FOUND COLUMNS\n"), F.array_join("lines", "\n")),
                F.lit(wanted),
            ).alias("request"),
        )
    )


def parse_suggestions(replies: DataFrame, key: str = "reply") -> DataFrame:
    """Suggestions in reply texts: key, line_no, scanned, target, confidence.

    A line counts if it has exactly three parts between bars and is not the
    heading. Confidence is the number its text starts with, else 0.
    """
    lines = replies.select(
        key, F.posexplode(F.split(trim_space(F.col("text")), "\n")).alias("line_no", "line")
    )
    line = trim_space(F.col("line"))
    parts = (
        lines.select(key, "line_no", line.alias("line"))
        .filter(~F.startswith("line", F.lit(HEADING)))
        .select(key, "line_no", F.split("line", r"\|").alias("parts"))
        .filter(F.size("parts") == 3)
    )
    return parts.select(
        key,
        "line_no",
        trim_space(F.get("parts", F.lit(0))).alias("scanned"),
        trim_space(F.get("parts", F.lit(1))).alias("target"),
        leading_number(F.get("parts", F.lit(2))).alias("confidence"),
    )


def accept_suggestions(suggestions: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Drop answers without a match and those below the wanted confidence."""
    return suggestions.filter((F.col("target") != NO_MATCH) & (F.col("confidence") >= min_confidence))


def apply_suggestions(
    accepted: DataFrame, normalized: DataFrame, targets: DataFrame, order: tuple[str, ...] = ("reply", "line_no")
) -> DataFrame:
    """Last suggestion per undecided header: scanned, target, confidence, in_targets.

    ``in_targets`` is false for a suggestion nobody can confirm, since its
    target is not in the list.
    """
    last = accepted.groupBy("scanned").agg(
        F.max(F.struct(*order, "target", "confidence")).alias("last")
    )
    decided = decided_headers(normalized).withColumnRenamed("header", "scanned")
    undecided = last.join(decided, "scanned", "left_anti").select(
        "scanned", "last.target", "last.confidence"
    )
    names = targets.select("target").distinct().withColumn("in_targets", F.lit(True))
    return lookup_join(undecided, names, ["target"], "left").select(
        "scanned", "target", "confidence", F.coalesce("in_targets", F.lit(False)).alias("in_targets")
    )


def suggestion_audit(sent: DataFrame, accepted: DataFrame) -> DataFrame:
    """What was sent and what came back: pos, header, outcome, target, confidence."""
    last = accepted.groupBy(F.col("scanned").alias("header")).agg(
        F.max(F.struct("reply", "line_no", "target", "confidence")).alias("last")
    )
    return salted_join(sent, last, ["header"], "left").select(
        "pos",
        "header",
        F.when(F.col("last").isNull(), "no match").otherwise("suggested").alias("outcome"),
        "last.target",
        "last.confidence",
    )


def suggest_similar(
    headers: DataFrame, targets: DataFrame, min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """Best target per header by name: scanned, target, confidence.

    Confidence is the larger of the overlap of the words (shared over all) and of
    the edit similarity, 1 - edits / length of the longer name, of the names in lower case with one
    space between words. Ties go to the first target in byte order. Both halves find all
    pairs from ``min_confidence`` on, without a cross join.
    """
    headers = stored(headers.select(F.col("header").alias("scanned")).distinct())
    found = _similar(headers, targets, words, min_confidence).unionByName(
        _edit_similar(headers, targets, min_confidence)
    )
    best = found.groupBy("scanned").agg(F.min(F.struct("minus_score", "target")).alias("best"))
    return best.select("scanned", "best.target", (-F.col("best.minus_score")).alias("confidence"))


def _word_pairs(
    headers: DataFrame, targets: DataFrame, tokens: Callable[[Column], Column], least: float
) -> DataFrame:
    """Exact set-similarity join of token sets with prefix filtering: tokens, t_tokens, target (the first of
    those with t_tokens), score.

    Two sets with an overlap of at least ``least`` share a token among the first
    ``n - ceil(least * n) + 1`` of each, whatever the order of tokens. Tokens are
    ordered by how few targets have them, so a frequent word joins only where a
    name has nothing rarer. Names with the same tokens are one set, scored once.
    The tables made from the targets are stored, since they are measured and used.
    """
    named = headers.withColumn("tokens", tokens(F.col("scanned")))
    wanted = (
        targets.withColumn("t_tokens", tokens(F.col("target")))
        .filter(F.size("t_tokens") > 0)
        .groupBy("t_tokens")
        .agg(F.min("target").alias("target"))
    )
    wanted = stored(wanted)
    frequency = stored(
        wanted.select(F.explode("t_tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )

    def prefix(sets: DataFrame, column: str) -> DataFrame:
        size = F.size(column)
        length = size - F.ceil(size * F.lit(least) - F.lit(1e-9)).cast("int") + 1
        ranked = (
            lookup_join(sets.select(column, F.explode(column).alias("token")), frequency, ["token"], "left")
            .groupBy(column)
            .agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("ranked"))
        )
        rare = F.filter(F.slice("ranked", F.lit(1), length), lambda r: r["n"] > 0)
        return ranked.select(column, F.explode(F.transform(rare, lambda r: r["token"])).alias("token"))

    sets = named.filter(F.size("tokens") > 0).select("tokens").distinct()
    targets_by_token = stored(prefix(wanted.select("t_tokens"), "t_tokens").join(wanted, "t_tokens"))
    pairs = lookup_join(prefix(sets, "tokens"), targets_by_token, ["token"])
    shared = F.size(F.array_intersect("tokens", "t_tokens"))
    score = shared / (F.size("tokens") + F.size("t_tokens") - shared)
    return pairs.select("tokens", "t_tokens", "target", score.alias("score")).filter(F.col("score") >= least)


def _similar(
    headers: DataFrame, targets: DataFrame, tokens: Callable[[Column], Column], least: float
) -> DataFrame:
    """Best target of each header by overlap of tokens: scanned, target, minus_score."""
    named = headers.withColumn("tokens", tokens(F.col("scanned")))
    best = (
        _word_pairs(headers, targets, tokens, least)
        .groupBy("tokens")
        .agg(F.min(F.struct((-F.col("score")).alias("minus_score"), "target")).alias("best"))
    )
    return salted_join(named, best, ["tokens"]).select("scanned", "best.target", "best.minus_score")


def _segments(text: str, longest: str, least: float) -> str:
    """SQL array of the segments of a text for a partner, with the most edits either allows.

    ``longest`` is the larger of both lengths. A text cut into one more segment than there are
    edits keeps one of them whole in its partner. Gives nr, start (from 0), size.
    """
    edits = f"cast(floor((1 - {least}) * {longest} + 1e-9) as int)"
    return f"""transform(sequence(0, {edits}), i -> named_struct('nr', i,
        'start', cast(i * ({text} div ({edits} + 1)) + greatest(0, i - ({edits} + 1 - {text} % ({edits} + 1))) as int),
        'size', cast({text} div ({edits} + 1) + if(i >= {edits} + 1 - {text} % ({edits} + 1), 1, 0) as int)))"""


def edit_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Exact edit-similarity join of distinct texts ``a`` and ``b``: a, b, score from ``least`` on.

    Texts of lengths l and h within ``e = (1 - least) * max(l, h)`` edits: b is cut into e + 1 segments, of which one
    is in a unchanged, at a place that the edits before and after it allow. So a and b meet by both lengths, the
    segment's number and its text; only then the distance is computed. ``least`` is above 0.
    """
    lengths = right.select(F.length("b").alias("l")).distinct()
    partners = F.expr(f"sequence(cast(greatest(1, ceil({least} * h - 1e-9)) as int), cast(floor(h / {least} + 1e-9) as int))")
    sizes = left.select(F.length("a").alias("h")).distinct().select("h", F.explode(partners).alias("l"))
    sizes = stored(sizes.join(lengths, "l"))
    cut = lookup_join(right.withColumn("l", F.length("b")), sizes, ["l"])
    cut = cut.select("b", "l", "h", F.explode(F.expr(_segments("l", "greatest(l, h)", least))).alias("s"))
    cut = cut.select("b", "l", "h", F.col("s.nr").alias("nr"), F.expr("substring(b, s.start + 1, s.size)").alias("piece"))
    tried = lookup_join(left.withColumn("h", F.length("a")), sizes, ["h"])
    tried = tried.select("a", "l", "h", F.explode(F.expr(_segments("l", "greatest(l, h)", least))).alias("s"))
    edits = f"cast(floor((1 - {least}) * greatest(l, h) + 1e-9) as int)"
    first = f"greatest(0, s.start - s.nr, s.start + h - l - ({edits} - s.nr))"
    last = f"least(h - s.size, s.start + s.nr, s.start + h - l + ({edits} - s.nr))"
    places = F.expr(f"if({last} >= {first}, sequence({first}, {last}), cast(array() as array<int>))")
    tried = tried.select("a", "l", "h", "s", F.explode(places).alias("at"))
    tried = tried.select("a", "l", "h", F.col("s.nr").alias("nr"), F.expr("substring(a, at + 1, s.size)").alias("piece")).distinct()
    pairs = salted_join(tried, stored(cut), ["l", "h", "nr", "piece"]).select("a", "b").distinct()
    score = 1 - F.levenshtein("a", "b") / F.greatest(F.length("a"), F.length("b"))
    return pairs.withColumn("score", score).filter(F.col("score") >= least - 1e-12)


def _edit_similar(headers: DataFrame, targets: DataFrame, least: float) -> DataFrame:
    """Best target of each header by edit similarity: scanned, target, minus_score."""
    named = headers.withColumn("a", plain(F.col("scanned"))).filter("a != ''")
    wanted = targets.withColumn("b", plain(F.col("target"))).filter("b != ''")
    wanted = stored(wanted.groupBy("b").agg(F.min("target").alias("target")))
    pairs = edit_pairs(named.select("a").distinct(), wanted.select("b"), least)
    best = (
        lookup_join(pairs, wanted, ["b"])
        .groupBy("a")
        .agg(F.min(F.struct((-F.col("score")).alias("minus_score"), "target")).alias("best"))
    )
    return salted_join(named, best, ["a"]).select("scanned", "best.target", "best.minus_score")


def candidate_pairs(headers: DataFrame, targets: DataFrame, least: float = 0.5) -> DataFrame:
    """Distinct scanned, target that are similar by words or by edits, from ``least`` on.

    Found over distinct token sets and spellings, and spread to the names that have them.
    """
    headers = headers.select(F.col("header").alias("scanned")).distinct()
    targets = targets.select("target").distinct()
    sets = _word_pairs(headers, targets, words, least).select("tokens", "t_tokens").distinct()
    by_words = salted_join(headers.withColumn("tokens", words(F.col("scanned"))), sets, ["tokens"])
    by_words = salted_join(by_words, targets.withColumn("t_tokens", words(F.col("target"))), ["t_tokens"])
    named = headers.withColumn("a", plain(F.col("scanned"))).filter("a != ''")
    wanted = targets.withColumn("b", plain(F.col("target"))).filter("b != ''")
    alike = edit_pairs(named.select("a").distinct(), stored(wanted.select("b").distinct()), least)
    by_edits = salted_join(salted_join(named, alike.select("a", "b"), ["a"]), wanted, ["b"])
    return by_words.select("scanned", "target").unionByName(by_edits.select("scanned", "target")).distinct()


def suggest_scored(
    headers: DataFrame,
    targets: DataFrame,
    load: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]],
    min_confidence: float = MIN_CONFIDENCE,
    candidates: float = 0.5,
) -> DataFrame:
    """Best target per header by a user's model: scanned, target, confidence.

    ``load`` is called once in every task and gives a function from two series, headers and
    targets, to a series of scores; it gets ``candidate_pairs`` in Arrow batches, never all pairs. A score that is
    null or not a number is no match; ties go to the first target in byte order. For ``jobs.map_headers``:
    ``scorer=lambda headers, targets: suggest_scored(headers, targets, load)``.
    """

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for names, wanted in batches:
            yield model(names, wanted)

    found = candidate_pairs(headers, targets, candidates).withColumn("score", scored("scanned", "target"))
    found = found.filter(~F.isnan("score") & (F.col("score") >= min_confidence))
    best = found.groupBy("scanned").agg(F.min(F.struct((-F.col("score")).alias("minus_score"), "target")).alias("best"))
    return best.select("scanned", "best.target", (-F.col("best.minus_score")).alias("confidence"))
