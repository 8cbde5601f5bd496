"""Words of a batch of texts as arrays: where each begins and ends, and a 64-bit hash of its bytes.

All alphabets here are decided byte by byte in UTF-8 (separators are ASCII), so a batch is cut without decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
BASE = 0xD6E8FEB86659FD93
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
BYTE_VALUE_FOLDED = BYTE_VALUE[FOLD]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_OR_HIGH = np.zeros(256, dtype=bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    ALNUM_OR_HIGH[_a:_b] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i below n at least."""
    if len(_powers.get("up", ())) < n:
        n = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            step = np.full(n, np.uint64(base))
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row's begin (one more at the end); null: none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    cuts = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[cuts[0] : cuts[-1]], cuts - cuts[0]


@dataclass
class Words:
    """The words of rows ``first`` to ``first + n_rows - 1``: byte places in ``data``, row (from 0) and hash of each; ``at``: where rows begin; ``total``: running sum of the bytes' values."""

    first: int
    n_rows: int
    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    total: np.ndarray

    def rows(self) -> np.ndarray:
        """Where each row's words begin (one more at the end)."""
        return np.searchsorted(self.row, np.arange(self.n_rows + 1))

    def at_row(self) -> np.ndarray:
        """Each word's place in its row."""
        return np.arange(len(self.row)) - self.rows()[self.row]

    def beginnings(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word, 0 for words that are not longer."""
        _, down = powers(len(self.data) + 1)
        stop = np.minimum(self.start + size, self.end)
        hashed = mix64((self.total[stop] - self.total[self.start]) * down[self.start] + np.uint64(size * BASE % (1 << 64)))
        return np.where(self.end - self.start > size, hashed, np.uint64(0))


def cut_words(texts: pa.Array, alphabet: np.ndarray = NOT_SPACE, *, fold: bool = False, chunk_bytes: int = CHUNK_BYTES) -> Iterator[Words]:
    """Words of ``texts``, a few rows at a time (whole rows, about ``chunk_bytes``), so that the arrays stay small."""
    data, cuts = text_bytes(texts)
    value = BYTE_VALUE_FOLDED if fold else BYTE_VALUE
    low, n = 0, len(cuts) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(cuts, cuts[low] + chunk_bytes, side="right")) - 1))
        part, at = data[cuts[low] : cuts[high]], cuts[low : high + 1] - cuts[low]
        inside = alphabet[part]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < len(part))]
        first[edge] = inside[edge]
        last[edge - 1] = inside[edge - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[part] * up[: len(part)], out=total[1:])
        hashed = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * GOLDEN)
        row = np.searchsorted(at, start, side="right") - 1
        yield Words(low, high - low, part, at, start, end, row, hashed, total)
        low = high


def gram_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words within a row, and the index of the word it begins at."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total = total * np.uint64(BASE) + w.hash[j : j + m]
    whole = np.flatnonzero(w.row[:m] == w.row[n - 1 :])
    return mix64(total[whole]), whole
