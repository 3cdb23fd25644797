"""Toxicity from a weighted lexicon, found by Aho-Corasick in folded text.

Text is put in lower case and folded: letters of other scripts that look Latin,
digits and signs written for letters. Everything that is no letter becomes one
space. The lexicon has beginnings of words and whole words with a weight each,
learned as log odds from labelled documents, and phrases that excuse a word
inside them. A word counts with the largest weight found at it. The sum and the
sum per word, by which length is normalised, give the score through a logistic
curve that is fitted on other labelled documents than the lexicon.

Learning looks at no more than ``SAMPLE`` labelled rows, those with the smallest
hash of their id. Everything else reads every text whole.

Defined results: null and empty texts have no word and score as the curve says
at zero; repeated rows score alike; labels that are null are not learned from; a
lexicon learned from no row of one kind is empty and scores every text below a
half; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrecover.llm.common import stored, tidied

#: Labelled rows that learning reads at most.
SAMPLE = 20_000
#: Entries of a lexicon, and of its excusing phrases, at most.
ENTRIES, PHRASES = 4_000, 1_000
#: Lengths of the word beginnings that may become entries.
SHORTEST, LONGEST = 3, 14
#: Evidence (likelihood ratio) and weight (log odds) that an entry needs.
EVIDENCE, WEIGHT = 18.0, 1.0

# Look-alikes of Latin letters in Cyrillic and Greek, and signs written for letters.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһκοαρντιυ", "aeopcyxijsdhkoapvtiu", strict=True))
SIGNS = dict(zip("013457@$", "oieastas", strict=True))
_FOLD = str.maketrans(LOOK_ALIKES | SIGNS)
_GAPS = re.compile(r"[\W_]+")


def folded(text: str | None) -> str:
    """Folded words with a space before, between and after them."""
    return f" {_GAPS.sub(' ', (text or '').lower().translate(_FOLD)).strip()} "


def held_out(doc_id: Column) -> Column:
    """Rows that are kept for testing: the checksum of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Lexicon:
    """Weights of entries (`` word`` a beginning, `` word `` a whole word), excusing phrases, and the curve."""

    weights: dict[str, float]
    phrases: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 1.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in self.phrases:
            found.add_word(phrase, (None, len(phrase)))
        for entry, weight in self.weights.items():
            found.add_word(entry, (weight, len(entry)))
        if len(found):
            found.make_automaton()
        return found


def hits(automaton, text: str) -> dict[int, float]:
    """Largest weight at each word of a folded text, by the place of the space before it."""
    best: dict[int, float] = {}
    if not len(automaton):
        return best
    excused = []
    for end, (weight, length) in automaton.iter(text):
        start = end - length + 1
        if weight is None:
            excused.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for start, end in excused:
        for place in [p for p in best if start <= p < end]:
            del best[place]
    return best


def features(total: float, words: int) -> tuple[float, float]:
    """What the curve looks at: the weight found, and that weight for each hundred words."""
    return math.log1p(total), math.log1p(100 * total / max(words, 1))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, with a light penalty so that it always ends."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    penalty = np.diag([1e-6, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - penalty @ beta
        step = np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + penalty, slope)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def _entries_of(text: str) -> set[str]:
    found = set()
    for word in set(folded(text).split()):
        found.add(f" {word[:64]} ")
        for n in range(SHORTEST, min(LONGEST, len(word)) + 1):
            found.add(f" {word[:n]}")
    return found


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            sums[toxic].update(_entries_of(text))
    entries = list(sums[1])
    for start in range(0, len(entries), 50_000):
        some = entries[start : start + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array([sums[1][e] for e in some], pa.int64()), pa.array([sums[0][e] for e in some], pa.int64())],
            names=["entry", "toxic", "clean"],
        )
    # An entry that is clean here may be toxic in another task.
    rest = [e for e in sums[0] if e not in sums[1]]
    for start in range(0, len(rest), 50_000):
        some = rest[start : start + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array([0] * len(some), pa.int64()), pa.array([sums[0][e] for e in some], pa.int64())],
            names=["entry", "toxic", "clean"],
        )


def _entropy(k: Column, n: Column) -> Column:
    """log likelihood of k in n at its own rate."""
    term = lambda a: F.when(a > 0, a * F.log(a / n)).otherwise(0.0)
    return term(k) + term(n - k)


def learn_lexicon(sample: DataFrame, min_toxic: int = 4) -> dict[str, float]:
    """Entries that tell toxic from clean documents, with their log odds. ``sample``: text, toxic."""
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = sample.select("text", "toxic").mapInArrow(tidied(_counts), "entry string, toxic long, clean long")
    counts = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    weight = F.log((a + 0.5) / (n1 + 1.0)) - F.log((b + 0.5) / (n0 + 1.0))
    evidence = 2 * (
        _entropy(a, F.lit(float(n1))) + _entropy(b, F.lit(float(n0))) - _entropy(a + b, F.lit(float(n1 + n0)))
    )
    found = counts.filter(F.col("toxic") >= min_toxic).select("entry", weight.alias("weight"), evidence.alias("evidence"))
    found = found.filter((F.col("weight") >= WEIGHT) & (F.col("evidence") >= EVIDENCE))
    best = found.orderBy(F.desc("evidence"), "entry").limit(ENTRIES).collect()
    return {r["entry"]: float(r["weight"]) for r in best}


def learn_phrases(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Pairs of words, one of them an entry, that clean documents use and toxic ones hardly do."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                flat = folded(text)
                seen = set()
                for start in hits(automaton, flat):
                    end = flat.index(" ", start + 1)
                    if end + 1 < len(flat):
                        seen.add(flat[start : flat.index(" ", end + 1) + 1])
                    if start > 0:
                        seen.add(flat[flat.rindex(" ", 0, start) : end + 1])
                out += [(p, toxic) for p in seen if len(p) <= 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in out], pa.string()), pa.array([t for _, t in out], pa.int32())], names=["phrase", "toxic"]
            )

    counts = sample.select("text", "toxic").mapInArrow(tidied(pairs), "phrase string, toxic int").groupBy("phrase")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    found = counts.filter((F.col("clean") >= 3) & (F.col("clean") >= 20 * F.col("toxic")))
    return [r["phrase"] for r in found.orderBy(F.desc("clean"), "phrase").limit(PHRASES).collect()]


def measured(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``toxic``, the ``total`` weight and the number of ``words`` of every text of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            flat = [folded(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("toxic"),
                    pa.array([sum(hits(automaton, t).values()) for t in flat], pa.float64()),
                    pa.array([len(t.split()) for t in flat], pa.int64()),
                ],
                names=["toxic", "total", "words"],
            )

    return sample.select("toxic", "text").mapInArrow(tidied(run), "toxic int, total double, words long")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Lexicon:
    """Learn entries, phrases and curve from labelled rows that are not held out.

    ``labels``: the id and ``toxic``. At most ``sample`` ids are read, those with the smallest hash, and
    one text of each, the smallest of those the id has.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic")
    rows = stored(rows.agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) < 2
    lexicon = Lexicon(learn_lexicon(rows.filter(half)))
    if not lexicon.weights:
        return lexicon
    lexicon.phrases = learn_phrases(rows.filter(half), lexicon)
    points = measured(rows.filter(~half), lexicon).collect()
    y = np.array([r["toxic"] for r in points], float)
    if 0 < y.sum() < len(y):
        lexicon.curve = _curve(np.array([features(r["total"], r["words"]) for r in points]), y)
    return lexicon


def probability(lexicon: Lexicon, automaton, text: str | None) -> float:
    """Score of one text, from 0 to 1."""
    flat = folded(text)
    total = sum(hits(automaton, flat).values())
    bias, *slopes = lexicon.curve
    z = bias + sum(s * x for s, x in zip(slopes, features(total, len(flat.split())), strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row; predicted is 1 from a score of a half on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [probability(lexicon, automaton, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                names=["doc_id", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_col: str = "text") -> DataFrame:
    """The rows whose score is below a half, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            scores = [probability(lexicon, automaton, t) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([s < 0.5 for s in scores], pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)
