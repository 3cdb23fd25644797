"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

CLASH = "block string, n_tokens string, key string, total string, words string, node string, rest string, kept string"
SCHEMA = f"doc_id long, text string, {CLASH}"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, rows, schema=SCHEMA):
    extra = ("x",) * (schema.count(",") - 1)
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], schema)


def odd_rows():
    """Ids and texts; id 7 is repeated as it is, id 8 with another text, two rows have no id."""
    base = prose(1, 160)
    return [
        (1, base),
        (2, base),
        (3, base.replace("w1 ", "other ", 1)),
        (4, ""),
        (5, None),
        (6, "   \t\n "),
        (7, prose(2, 70)),
        (7, prose(2, 70)),
        (8, prose(3, 70)),
        (8, prose(4, 70)),
        (None, base),
        (None, None),
        (9, "one"),
        (10, "one"),
        (11, "Éa　b<|endoftext|>c \x1c d e"),
        (12, "a" * 5000),
        (13, prose(5, 4000)),
        (14, "x y " + " ".join(base.split()[20:120]) + " z"),
    ]
