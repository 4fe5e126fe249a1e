"""An FM-index over a sequence of symbols, with vectorised search (NumPy).

Symbols are positive integers. The Burrows-Wheeler transform lies in a wavelet matrix (one bit
row for each bit of a symbol), so the index takes bits, not words, for each symbol and level;
text positions are kept only for every ``step``-th suffix and found by walking back.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit row with rank."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, np.uint64)
        words.view(np.uint8)[: len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Access and rank of symbols in a sequence."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels: list[tuple[int, Bits, int]] = []
        rest = symbols
        for shift in range(max(1, int(most).bit_length()) - 1, -1, -1):
            ones = ((rest >> shift) & 1).astype(bool)
            self.levels.append((shift, Bits(ones), int(len(ones) - ones.sum())))
            rest = np.concatenate([rest[~ones], rest[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in front of its position."""
        low = np.zeros_like(at)
        for shift, bits, zeros in self.levels:
            one = ((symbols >> shift) & 1).astype(bool)
            ones_low, ones_at = bits.rank(low), bits.rank(at)
            low = np.where(one, zeros + ones_low, low - ones_low)
            at = np.where(one, zeros + ones_at, at - ones_at)
        return at - low

    def get(self, at: np.ndarray) -> np.ndarray:
        found = np.zeros(len(at), np.int64)
        for shift, bits, zeros in self.levels:
            one = bits.get(at)
            ones = bits.rank(at)
            found |= one.astype(np.int64) << shift
            at = np.where(one, zeros + ones, at - ones)
        return found


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes by prefix doubling; the last symbol must be a unique smallest one."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    reach = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - reach] = rank[reach:] + 1 if reach < n else 0
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        reach *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, step: int = 16):
        text = np.concatenate([symbols.astype(np.int64), [0]])
        order = suffix_order(text)
        most = int(text.max())
        counts = np.bincount(text, minlength=most + 1)
        self.most, self.size, self.step = most, len(text), step
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.last = WaveletMatrix(text[order - 1], most)
        sampled = order % step == 0
        self.marked = Bits(sampled)
        self.sampled = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffix range [low, high) of each phrase.

        ``phrases`` has one row for each phrase, filled to the right; symbols the text lacks
        give an empty range.
        """
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        for back in range(1, phrases.shape[1] + 1 if len(phrases) else 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back]
            known = symbol <= self.most
            high[live[~known]] = low[live[~known]]
            live, symbol = live[known], symbol[known]
            low[live] = self.first[symbol] + self.last.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.last.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking back to sampled ones."""
        found = np.empty(len(rows), np.int64)
        at, which, steps = rows.copy(), np.arange(len(rows)), 0
        while len(at):
            hit = self.marked.get(at)
            found[which[hit]] = self.sampled[self.marked.rank(at[hit])] + steps
            at, which = at[~hit], which[~hit]
            symbol = self.last.get(at)
            at = self.first[symbol] + self.last.rank(symbol, at)
            steps += 1
        return found


def ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of the ranges, and the number of the range of each."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    begin = np.cumsum(sizes) - sizes
    return low[owner] + np.arange(len(owner)) - begin[owner], owner
