"""FM-index over integer sequences: a wavelet matrix over the Burrows-Wheeler transform, in numpy.

Queries are answered for many patterns or rows at once; each step is a handful of array operations.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit sequence, packed, with counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64 if len(bits) >= 1 << 31 else np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, n_symbols: int) -> None:
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.bits: list[BitRank] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (values >> level & 1).astype(bool)
            self.bits.append(BitRank(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        # where each symbol's own places begin in the last level
        self.begin = np.zeros(n_symbols, np.int64)
        self.begin = self.descend(np.arange(n_symbols), self.begin)

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = bits.ones(i)
            i = np.where(symbol >> (self.levels - 1 - k) & 1, zeros + one, i - one)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        return self.descend(symbol, i) - self.begin[symbol]

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        start, symbol = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            one = bits.get(i)
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
            symbol = symbol << 1 | one
        return symbol, i - start


def sort_suffixes(values: np.ndarray, depth: int | None) -> np.ndarray:
    """Places in the order of their suffixes, by their first ``depth`` symbols at least (None: wholly); ties by place."""
    n = len(values)
    order = np.argsort(values, kind="stable")
    rank = np.zeros(n, np.int64)
    known = 1
    while True:
        key = values[order] if known == 1 else key[order]  # noqa: F821
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if n else np.zeros(0, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1 or (depth is not None and known >= depth):
            return order
        behind = np.zeros(n, np.int64)
        behind[: n - known] = rank[known:] + 1 if known < n else 0
        key = rank * np.int64(n + 1) + behind
        order = np.argsort(key, kind="stable")
        known *= 2


class FMIndex:
    """Index of ``values`` (0 to ``n_symbols - 1``; 0 separates and is never searched for).

    ``depth``: the longest pattern to be searched, where places are not located by steps; None sorts whole suffixes, and
    ``sample`` keeps the places of every so-manyeth position, from which :meth:`locate` steps.
    """

    def __init__(self, values: np.ndarray, n_symbols: int, *, depth: int | None = None, sample: int = 8) -> None:
        values, n_symbols = np.concatenate([np.asarray(values, np.int64) + 1, [0]]), n_symbols + 1  # 0 now ends the sequence, once
        self.size = len(values)
        self.suffixes = sort_suffixes(values, depth)
        self.bwt = WaveletMatrix(values[self.suffixes - 1], n_symbols)
        self.first = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(values, minlength=n_symbols), out=self.first[1:])
        if depth is None:
            marked = (self.suffixes % sample == 0) | (self.suffixes == self.size - 1)
            self.marked, self.places = BitRank(marked), self.suffixes[marked]
            del self.suffixes

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: from the rows of each pattern to the rows of that pattern after ``symbol``."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]) + 1, np.concatenate([low, high]))
        start = self.first[symbol + 1]
        return start + both[: len(low)], start + both[len(low) :]

    def search(self, patterns: list[np.ndarray] | np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of patterns (one a row, right-aligned in the array, so that the last column is each one's last symbol)."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size, np.int64)
        width = patterns.shape[1]
        live = np.arange(len(lengths))
        for step in range(width):
            live = live[(lengths[live] > step) & (high[live] > low[live])]
            if not len(live):
                break
            low[live], high[live] = self.extend(patterns[live, width - 1 - step], low[live], high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of index rows, by steps back to the nearest sampled one."""
        out, steps, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        rows = rows.astype(np.int64)
        while len(todo):
            there = self.marked.get(rows[todo])
            hit = todo[there]
            out[hit] = self.places[self.marked.ones(rows[hit])] + steps[hit]
            todo = todo[~there]
            if len(todo):
                symbol, rank = self.bwt.symbol_and_rank(rows[todo])
                rows[todo] = self.first[symbol] + rank
                steps[todo] += 1
        return out
