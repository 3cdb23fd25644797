"""An FM-index over word sequences: suffix order, wavelet matrix, backward search.

Words are numbers. The index holds the Burrows-Wheeler transform of all sequences
as a wavelet matrix of packed bits with counts, and for every class of positions
that agree in their next ``window`` words the smallest document; the suffix
order itself is dropped after building. Searches step many sequences at once.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with the number of ones before every word of 64."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        room = np.zeros((n // 64 + 1) * 8, np.uint8)
        room[: len(packed)] = packed
        self.words = room.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Rank of any symbol at any place, one packed bit per symbol and level."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.shifts = range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1)
        self.levels: list[tuple[Bits, int]] = []
        for shift in self.shifts:
            bits = ((symbols >> shift) & 1).astype(bool)
            self.levels.append((Bits(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        self.first = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, (bits, zeros) in zip(self.shifts, self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.first[symbol]


def suffix_order(symbols: np.ndarray, depth: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their next ``depth`` symbols or more, and ranks by their next ``keep`` ones.

    ``keep`` is a power of two. Ranks of twice as many symbols come from pairs of ranks.
    """
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    kept = rank
    order = np.argsort(rank, kind="stable")
    seen = 1
    while seen < max(depth, keep):
        follow = np.zeros(n, np.int64)
        follow[: n - seen] = rank[seen:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        seen *= 2
        if seen == keep:
            kept = rank
    return order, kept


class FMIndex:
    """Index of sequences, each with the number of its document.

    ``sequences`` are lists of words; ``window`` is the number of words whose
    occurrences are looked for, 2 at least.
    """

    def __init__(self, sequences: list[list[bytes]], documents: list[int], window: int):
        self.window = window
        numbers: dict[bytes, int] = {}
        coded = [np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in s), np.int64, len(s)) for s in sequences]
        self.sequences = coded
        # Symbol 0 ends every sequence, so no occurrence runs over an end.
        text = np.concatenate([np.append(c, 0) for c in coded])
        owner = np.repeat(np.array(documents, np.int64), [len(c) + 1 for c in coded])
        n, n_symbols = len(text), len(numbers) + 1
        power = 1 << (window.bit_length() - 1)
        order, ranks = suffix_order(text, max(map(len, coded)) + 1, power)
        self.size = n
        self.matrix = WaveletMatrix(text[order - 1], n_symbols)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        follow = np.full(n, -1, np.int64)
        follow[: n - (window - power)] = ranks[window - power :]
        one, two = ranks[order], follow[order]
        new = np.ones(n, bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.classes = Bits(new)
        self.smallest = np.minimum.reduceat(owner[order], np.flatnonzero(new))

    def smallest_documents(self) -> list[np.ndarray]:
        """For every window of every indexed sequence the smallest document in which it occurs.

        All sequences are read backwards together, one word a step; the interval of the words
        read so far starts with a position whose class is that of the window read last.
        """
        by_length = sorted(range(len(self.sequences)), key=lambda i: -len(self.sequences[i]))
        lengths = np.array([len(self.sequences[i]) for i in by_length])
        longest = int(lengths[0])
        backwards = np.zeros((longest, len(by_length)), np.int64)
        for lane, i in enumerate(by_length):
            backwards[: lengths[lane], lane] = self.sequences[i][::-1]
        found = np.full((longest, len(by_length)), np.iinfo(np.int64).max)
        low = np.zeros(len(by_length), np.int64)
        for step in range(longest):
            active = int(np.searchsorted(-lengths, -step, side="left"))
            low = low[:active]
            symbol = backwards[step, :active]
            low = self.starts[symbol] + self.matrix.rank(symbol, low)
            if step >= self.window - 1:
                found[step, :active] = self.smallest[self.classes.rank(low + 1) - 1]
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(by_length)
        for lane, i in enumerate(by_length):
            out[i] = found[self.window - 1 : lengths[lane], lane][::-1]
        return out
