"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tabrecover.llm import minhash_forest, substring_dedup
from tabrecover.llm.components import components
from tabrecover.llm.fm_index import FMIndex
from tabrecover.llm.shingles import shingle_set

from .cases import SCHEMA, documents, odd_rows, prose


def shingles(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_components(rows, percent):
    """Component of every row: rows of one id are one node."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b = rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(rows):
        if a is not None:
            least[find(i)] = min(least.get(find(i), a), a)
    out = Counter()
    for i, (a, _) in enumerate(rows):
        component = None if a is None else least[find(i)]
        out[a, len(sets[i]), component, a is None or a == component] += 1
    return out


def clusters():
    """A crowd of near copies of one text with one word in a few changed, some similar enough and some not."""
    rng = random.Random(5)
    base = prose(11, 120).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    return rows


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, percent):
    rows = [r for r in odd_rows() if r[0] != 8] + clusters()
    found = minhash_forest.near_duplicates(documents(spark, rows), percent=percent)
    assert Counter(tuple(r) for r in found.collect()) == brute_components(rows, percent)


def test_rows_of_one_id_and_empty_table(spark):
    rows = [(1, prose(1, 60)), (1, prose(2, 60)), (2, prose(2, 60))]
    found = minhash_forest.near_duplicates(documents(spark, rows)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in found} == {(1, 1), (2, 1)}
    assert minhash_forest.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_crowds_split_by_depth(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "MEETING", 20)
    monkeypatch.setattr(minhash_forest, "UNIT", 40)
    rows = clusters()
    found = minhash_forest.near_duplicates(documents(spark, rows))
    assert Counter(tuple(r) for r in found.collect()) == brute_components(rows, 85)


def variants(n):
    """A text and variants that are 0.858 similar to it and 0.74 to each other, so only it links them."""
    rng = random.Random(17)
    base = prose(19, 200, 5000).split()
    rows = [(5000, " ".join(base))]
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(8, 190, 6), 3):
            words[at] = f"own{i}at{at}"
        rows.append((5001 + i, " ".join(words)))
    return rows


def test_large_crowds_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(minhash_forest, "MEETING", 20)
    for rows in (clusters(), variants(150)):
        found = minhash_forest.near_duplicates(documents(spark, rows))
        assert Counter(tuple(r) for r in found.collect()) == brute_components(rows, 85)


def test_crowds_around_the_bound(spark, monkeypatch):
    """All sets meet first in tree 0, whose crowd is above the bound; the crowds of the other trees are below."""
    rng = random.Random(23)
    base = prose(29, 200, 5000).split()

    def first(words):
        return np.frombuffer(minhash_forest.signature(shingle_set(" ".join(words))), ">u4")[:5].tolist()

    own, rows = first(base), [(7000, " ".join(base))]
    while len(rows) < 160:
        words = list(base)
        for at in rng.sample(range(rng.randrange(4, 10), 190, 6), 3):
            words[at] = f"own{len(rows)}at{at}"
        if first(words)[:4] == own[:4] and first(words)[4] != own[4]:
            rows.append((7000 + len(rows), " ".join(words)))
    monkeypatch.setattr(minhash_forest, "MEETING", 150)
    found = minhash_forest.near_duplicates(documents(spark, rows))
    assert Counter(tuple(r) for r in found.collect()) == brute_components(rows, 85)


def crowd(n):
    """Near copies of one text that are hardly ever similar enough to each other."""
    rng = random.Random(41)
    base = prose(43, 200, 5000).split()
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(8, 190, 6), 4):
            words[at] = f"own{i}at{at}"
        rows.append((9000 + i, " ".join(words)))
    return rows


def test_rows_grow_with_the_crowd(spark, monkeypatch):
    """Four times the near copies: five times the rows at most, or one row per copy and tree."""
    counts = {}
    for n in (300, 1200):
        sizes = counts[n] = []

        def counted(df, *args, real=minhash_forest.stored, sizes=sizes):
            out = real(df, *args)
            sizes.append(out.count())
            return out

        monkeypatch.setattr(minhash_forest, "stored", counted)
        rows = crowd(n)
        found = minhash_forest.near_duplicates(documents(spark, rows))
        assert n > 300 or Counter(tuple(r) for r in found.collect()) == brute_components(rows, 85)
        monkeypatch.undo()
    assert len(counts[300]) == len(counts[1200])
    bound = 1200 * minhash_forest.TREES
    assert all(b <= max(5 * a, bound) for a, b in zip(counts[300], counts[1200], strict=True)), str(counts)


def test_joining_links():
    """A forest of links, none between sets that are joined already."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(60)]
    every = [(i, j) for i in range(60) for j in range(i + 1, 60)]
    found = list(minhash_forest.joining_links(sets, list(range(60)), iter(every), 50))

    def similar(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= 50 * (len(sets[i]) + len(sets[j]) - both)

    def groups(pairs):
        root = list(range(60))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [b if x == a else x for x in root]
        return [root.index(x) for x in root]

    assert all(similar(i, j) for i, j in found) and len(found) < 60
    assert groups(found) == groups([p for p in every if similar(*p)])


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 180)] + [(0, i) for i in range(1, 60)] + [(300, 300), (None, 4)]
    edges += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert found == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def brute_removed(rows, window):
    split = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), words in zip(rows, split, strict=True):
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if i is not None and first.get(key, i) >= i:
                first[key] = i
    out = Counter()
    for (i, _), words in zip(rows, split, strict=True):
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if i is not None and first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        left = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i, len(words), sum(gone), hashlib.sha256(left).hexdigest()] += 1
    return out


def repeated():
    """One passage in many surroundings, chains of overlaps, and a long run of one word."""
    passage = prose(21, 130).split()
    rows = [(2000 + i, " ".join([prose(100 + i, 30), *passage[i % 40 : 90 + i % 40], prose(300 + i, 25)])) for i in range(60)]
    return [*rows, (3000, "go " * 700), (3001, "go " * 90 + "stop"), (3002, " ".join(passage))]


@pytest.mark.parametrize("crowd, shard_words", [(4096, 600_000), (3, 100)])
def test_remove_repeats(spark, crowd, shard_words):
    rows = odd_rows() + repeated()
    found = substring_dedup.remove_repeats(
        documents(spark, rows), as_text=False, crowd=crowd, shard_words=shard_words
    ).select("doc_id", "n_words", "n_removed", "kept")
    assert Counter(tuple(r) for r in found.collect()) == brute_removed(rows, 50)


def test_remove_repeats_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fm_index():
    rng = np.random.default_rng(1)
    sequences = [[b"%d" % x for x in rng.integers(0, 3, rng.integers(5, 60))] for _ in range(40)]
    documents_ = rng.integers(0, 30, 40).tolist()
    least = {}
    for s, d in zip(sequences, documents_, strict=True):
        for k in range(len(s) - 4):
            key = tuple(s[k : k + 5])
            least[key] = min(least.get(key, d), d)
    index = FMIndex(sequences, documents_, 5)
    for s, found in zip(sequences, index.smallest_documents(), strict=True):
        assert found.tolist() == [least[tuple(s[k : k + 5])] for k in range(len(s) - 4)]
