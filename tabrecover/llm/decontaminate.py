"""Benchmark items inside documents, found by CGK walks, bit sampling and exact edit distance.

A document leaks an item if some stretch of its words differs from the item's
words by at most ``RATE`` edits per item word (words put in, left out or changed).

The CGK walk turns edit distance into Hamming distance: it copies the word it
stands on, and a random bit, drawn from the step and the word, says whether it
moves on; two texts that differ by an edit soon walk in step again. Two walks that start
together agree at ever fewer places the longer they are, so an item is cut into pieces of at most
``PIECE`` words: if a copy has few enough edits, so has its part of one piece at least. Windows the size of
a piece are embedded ``REPEATS`` times and ``SAMPLES`` places of each walk make a bucket; a window is a
candidate only if it meets its piece in some bucket. With every start within the edits allowed a piece
and its copy meet in one repeat with a chance of ``MEETING`` or more (measured for 8 to
28 words and each kind of edit at the full rate), which makes the number of repeats for ``TARGET``.
Candidates are verified by the exact edit distance of the whole item.

Windows are not embedded where no copy can be, which loses nothing: a piece with e edits
keeps, in one run, at least (n - e) / (e + 1) of its n words, so a window without
any such run of its piece, or with fewer than n - e of its words, is none of its copies; the run's place
says where the window starts, give or take e words. A window is embedded once, however many pieces
it may be a copy of.

Words are runs of letters and digits, in lower case, cut by ASCII signs, white space and the signs of scripts
without spaces, whose characters are a word each.
Defined results: null and empty texts leak nothing; items of fewer than
``MIN_WORDS`` words leak as exact sequences of words only, items without words not at all;
equal items and repeated rows are reported each; an empty table on either
side gives no rows; other columns are not looked at. Items are handed to the
tasks in blocks of at most ``BLOCK_BYTES``, as many as the benchmark needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrecover.llm.shingles import mixed, rolling, word_hashes

#: Edits per word of an item that a copy may have.
RATE = 0.2
MIN_WORDS = 8
#: Words of a piece of an item at most.
PIECE = 24
#: Places that make a bucket, the chance that a copy meets its piece in one, and the share of copies that are to be found.
SAMPLES, MEETING, TARGET = 2, 0.25, 0.9999
BLOCK_BYTES = 8 << 20

_BITS = 22
_PAD = np.uint64(0)
_KEEP = bytes(
    c if chr(c).isalnum() and c < 128 and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else c if c >= 128 else 32
    for c in range(256)
)


def repeats(meeting: float = MEETING, target: float = TARGET) -> int:
    """How often to embed so that the share ``target`` of copies meets its item in some bucket."""
    return ceil(log(1 - target) / log(1 - meeting))


REPEATS = repeats()


# Signs and characters of scripts that do not put spaces between words.
_SIGNS = re.compile("[\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
_UNSPACED = re.compile(
    "([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])"
)


def plain_words(text: str | None) -> list[bytes]:
    text = text or ""
    if not text.isascii():
        text = _UNSPACED.sub(r" \1 ", _SIGNS.sub(" ", text))
    return text.encode().translate(_KEEP).split()


def edits_allowed(n: int, rate: float = RATE) -> int:
    return int(rate * n + 1e-9)


def run_length(n: int, edits: int) -> int:
    """Words in one run that are left of an item of n words after so many edits."""
    return max(1, -(-(n - edits) // (edits + 1)))


def sampled(sizes: np.ndarray, repeat: int) -> np.ndarray:
    """Places of the walk that make the bucket of each size: one row of ``SAMPLES`` for each window."""
    shares = np.random.default_rng(repeat).random(SAMPLES)
    return (shares[None, :] * 2 * sizes[:, None]).astype(np.int64)


def embedded(tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray, repeat: int, steps: int) -> np.ndarray:
    """CGK walks of windows side by side, the first steps of each; ``sizes`` are the words they have."""
    out = np.full((len(starts), steps), _PAD)
    at = np.zeros(len(starts), np.int64)
    last = len(tokens) - 1
    for step in range(steps):
        word = np.where(at < sizes, tokens[np.minimum(starts + at, last)], _PAD)
        out[:, step] = word
        salt = (repeat * 0x1000003 + step * 0x9E3779B1 + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        at += (mixed(word ^ np.uint64(salt)) & np.uint64(1)).astype(np.int64)
    return out


def buckets(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, repeat: int) -> np.ndarray:
    """One number per window of the size of an item; words from ``ends`` on are not there."""
    places = sampled(sizes, repeat)
    walks = embedded(tokens, starts, np.minimum(sizes, ends - starts), repeat, int(places.max()) + 1)
    out = sizes.astype(np.uint64)
    rows = np.arange(len(walks))
    for k in range(SAMPLES):
        out = mixed(out + walks[rows, places[:, k]])
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest edits between the item and any stretch of the text, and where the first such stretch ends."""
    n = len(text)
    places = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, word in enumerate(item):
        step = np.empty(n + 1, np.int64)
        step[0] = i + 1
        step[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        # A word put in costs one for each place further on.
        row = np.minimum.accumulate(step - places) + places
    end = int(row.argmin())
    return int(row[end]), end


def pieces(n: int, piece: int = PIECE) -> list[tuple[int, int]]:
    """Start and size of the pieces of an item of n words, as equal as can be."""
    count = -(-n // piece)
    starts = [i * n // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(starts, starts[1:])]


class Items:
    """Benchmark items made ready for search."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        self.ids, self.words, self.edits = [], [], []
        #: Of each piece: its item, place in it, size, edits and sorted words; and its buckets.
        self.item, self.place, self.size, self.slack, self.known, self.keys = [], [], [], [], [], []
        #: Items looked for as they are: first word to the items that begin with it.
        self.short: dict[int, list[int]] = {}
        runs: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            found = plain_words(text)
            if not found:
                continue
            hashes = word_hashes(found)
            own = len(self.ids)
            self.ids.append(item_id)
            self.words.append(hashes)
            if len(found) < MIN_WORDS:
                self.edits.append(0)
                self.short.setdefault(int(hashes[0]), []).append(own)
                continue
            self.edits.append(edits_allowed(len(found), rate))
            for place, size in pieces(len(found)):
                slack = edits_allowed(size, rate)
                part = hashes[place : place + size]
                width = run_length(size, slack)
                runs.setdefault(width, []).append((rolling(part, width), len(self.item)))
                self.item.append(own)
                self.place.append(place)
                self.size.append(size)
                self.slack.append(slack)
                self.known.append(np.unique(part))
                self.keys.append(part)
        self.first_words = np.array(sorted(self.short), np.uint64)
        self.item, self.place, self.size, self.slack = (np.array(x, np.int64) for x in (self.item, self.place, self.size, self.slack))
        self.keys = self._embedded_pieces()
        self.runs = {}
        for width, found in runs.items():
            keys = np.concatenate([k for k, _ in found])
            piece = np.concatenate([np.full(len(k), i) for k, i in found])
            offset = np.concatenate([np.arange(len(k)) for k, _ in found])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[keys >> np.uint64(64 - _BITS)] = True
            self.runs[width] = (seen, keys[order], piece[order], offset[order])

    def _embedded_pieces(self) -> np.ndarray:
        if not len(self.size):
            return np.empty((0, REPEATS), np.uint64)
        tokens, ends = np.concatenate(self.keys), np.cumsum(self.size)
        return np.stack([buckets(tokens, ends - self.size, ends, self.size, r) for r in range(REPEATS)], axis=1)

    def windows(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and starts of the windows that keep a run and enough words of their piece."""
        pairs = []
        for width, (seen, keys, piece, offset) in self.runs.items():
            grams = rolling(hashes, width)
            places = np.flatnonzero(seen[grams >> np.uint64(64 - _BITS)])
            low, high = np.searchsorted(keys, grams[places], "left"), np.searchsorted(keys, grams[places], "right")
            counts = high - low
            if not counts.sum():
                continue
            nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            at = np.repeat(low, counts) + nth
            pairs.append(np.stack([piece[at], np.repeat(places, counts) - offset[at]]))
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        piece, start = np.unique(np.concatenate(pairs, axis=1), axis=1)
        wide = 2 * self.slack[piece] + 1
        nth = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
        piece, start = np.repeat(piece, wide), np.repeat(start - self.slack[piece], wide) + nth
        piece, start = np.unique(np.stack([piece, start]), axis=1)
        keep = (start >= 0) & (start < len(hashes))
        return self._with_words(hashes, piece[keep], start[keep])

    def _with_words(self, hashes: np.ndarray, piece: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A copy has at most n + e words, and n - e of them are the piece's."""
        keep = np.ones(len(piece), bool)
        for a, b in zip(*_runs_of(piece)):
            own = int(piece[a])
            first, last = int(start[a]), min(len(hashes), int(start[b - 1]) + int(self.size[own] + self.slack[own]))
            known = np.concatenate([[0], np.cumsum(np.isin(hashes[first:last], self.known[own]))])
            high = np.minimum(start[a:b] + self.size[own] + self.slack[own], last) - first
            keep[a:b] = known[high] - known[start[a:b] - first] >= self.size[own] - self.slack[own]
        return piece[keep], start[keep]

    def near(self, texts: list[np.ndarray]) -> list[dict[int, list[tuple[int, int]]]]:
        """For each text the items that meet a window in a bucket, and the places in the text where the item would start.

        A piece's windows begin at every start its edits allow. Windows of all texts are embedded together.
        """
        out: list[dict[int, list[tuple[int, int]]]] = [{} for _ in texts]
        found = [self.windows(hashes) for hashes in texts]
        counts = [len(p) for p, _ in found]
        if not sum(counts):
            return [{} for _ in texts]
        lengths = np.array([len(t) for t in texts])
        text = np.repeat(np.arange(len(texts)), counts)
        piece = np.concatenate([p for p, _ in found])
        start = np.concatenate([s for _, s in found])
        tokens, ends = np.concatenate(texts), np.cumsum(lengths)
        at = (ends - lengths)[text] + start
        windows, which = np.unique(np.stack([at, self.size[piece], ends[text]]), axis=1, return_inverse=True)
        which = which.ravel()
        meets = np.zeros(len(piece), bool)
        for repeat in range(REPEATS):
            keys = buckets(tokens, windows[0], windows[2], windows[1], repeat)
            meets |= keys[which] == self.keys[piece, repeat]
        for t, p, s in zip(text[meets].tolist(), piece[meets].tolist(), start[meets].tolist(), strict=True):
            out[t].setdefault(int(self.item[p]), []).append((s - int(self.place[p]), int(self.slack[p])))
        return out

    def _verified(self, hashes: np.ndarray, i: int, places: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        words, edits = self.words[i], self.edits[i]
        spans = sorted((s - slack - edits, s + slack + len(words) + edits) for s, slack in places)
        best = None
        # Windows whose stretches overlap are verified together.
        merged = [list(spans[0])]
        for first, last in spans[1:]:
            if first <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        for first, last in merged:
            first, last = max(0, first), min(len(hashes), last)
            distance, end = edit_distance(words, hashes[first:last])
            if distance <= edits and (best is None or distance < best[0]):
                _, size = edit_distance(words[::-1], hashes[first : first + end][::-1])
                best = (distance, first + end - size, size)
        return best

    def _exact(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Short items at their first place in the text."""
        seen = set()
        if len(self.first_words):
            for place in np.flatnonzero(np.isin(hashes, self.first_words)).tolist():
                for i in self.short[int(hashes[place])]:
                    n = len(self.words[i])
                    if i not in seen and np.array_equal(hashes[place : place + n], self.words[i]):
                        seen.add(i)
                        yield i, 0, place, n

    def leaks(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, edits, first word, number of words) of the best copy of each leaked item."""
        out = []
        for hashes, near in zip(texts, self.near(texts), strict=True):
            rows = list(self._exact(hashes))
            for i, places in near.items():
                best = self._verified(hashes, i, places)
                if best:
                    rows.append((i, *best))
            out.append(rows)
        return out


def _runs_of(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Start and end of each run of equal values."""
    if not len(values):
        return [], []
    cuts = (np.flatnonzero(np.diff(values)) + 1).tolist()
    return [0, *cuts], [*cuts, len(values)]


_SCHEMA = "edits int, item_words int, first_word int, n_words int"


def _blocks(items: DataFrame, block_bytes: int):
    """The items in blocks of bounded size, each handed to all tasks; one block at least."""
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n_blocks = max(1, ceil(size / block_bytes))
    for block in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block)
        yield items.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = RATE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each document and item it leaks: ids, edits, words of the item, and where the copy lies."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    item_type, doc_type = (f.schema[0].dataType.simpleString() for f in (items, source))
    schema = f"doc_id {doc_type}, item_id {item_type}, {_SCHEMA}"
    result = None
    for shared in _blocks(items, block_bytes):
        found = source.mapInArrow(_search(shared, rate, source, items), schema)
        result = found if result is None else result.unionByName(found)
    return result


def _search(shared, rate: float, source: DataFrame, items: DataFrame):
    from pyspark.sql.pandas.types import to_arrow_schema

    types = [to_arrow_schema(f.schema).field(0).type for f in (source.select("doc_id"), items.select("item_id"))]
    types += [pa.int32()] * 4
    names = ["doc_id", "item_id", "edits", "item_words", "first_word", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Items(shared.value, rate)
            texts = [word_hashes(plain_words(t)) for t in batch.column("text").to_pylist()]
            rows = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), index.leaks(texts), strict=True):
                rows += [(doc, index.ids[i], edits, len(index.words[i]), first, n) for i, edits, first, n in found]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
            )

    return run


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = RATE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows that leak no item, with all their columns."""
    items = benchmark.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    for shared in _blocks(items, block_bytes):
        docs = docs.mapInArrow(_without(shared, rate, text_col), docs.schema)
    return docs


def _without(shared, rate: float, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            index = index or Items(shared.value, rate)
            texts = [word_hashes(plain_words(t)) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array([not found for found in index.leaks(texts)], pa.bool_()))

    return run
