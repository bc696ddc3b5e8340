"""An FM-index over sequences of numbers: backward search, and positions from sampled suffixes.

The rows of the index are the suffixes of the sequence in order. The column of
the symbols before them (the Burrows-Wheeler transform) is kept in a wavelet
matrix, which counts a symbol up to any row in one step for each bit of the
largest symbol. Everything works on arrays of patterns or rows at once.
"""

from __future__ import annotations

import numpy as np

#: Every such position of the sequence has its row marked; others are reached by steps back.
SAMPLE = 16


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The order of the suffixes, by prefix doubling. The last symbol must be smaller than all others."""
    n = len(symbols)
    # as many symbols as fit into one number are compared at once to begin with
    bits = max(1, int(symbols.max()).bit_length())
    step = min(n, max(1, 62 // bits))
    key = np.zeros(n, np.int64)
    for k in range(step):
        key <<= bits
        key[: n - k] |= symbols[k:]
    order = np.argsort(key, kind="stable")
    first = np.ones(n, bool)
    first[1:] = key[order][1:] != key[order][:-1]
    # a rank is the first row of its group, so that it stays ahead of the groups behind it
    starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = starts
    # only suffixes that share their rank with another need a further look
    rows = np.flatnonzero(~first | ~np.append(first[1:], True))
    while step < n and len(rows):
        suffixes = order[rows]
        after = suffixes + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[suffixes] * (n + 2) + second
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[rows] = suffixes
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rank[suffixes] = rows[starts]
        rows = rows[~new | ~np.append(new[1:], True)]
        step *= 2
    return order


class WaveletMatrix:
    """Counts how often a symbol occurs before a row."""

    def __init__(self, column: np.ndarray, bits: int):
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for b in range(bits - 1, -1, -1):
            bit = (column >> b) & 1
            before = np.zeros(len(column) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(column) - int(before[-1]))
            column = np.concatenate((column[bit == 0], column[bit == 1]))

    def rank(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of each pair, how often the symbol occurs before the row."""
        begin, end = np.zeros_like(rows), rows.copy()
        for level in range(self.bits):
            one = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            before = self.ones[level]
            a, b = before[begin], before[end]
            begin = np.where(one, self.zeros[level] + a, begin - a)
            end = np.where(one, self.zeros[level] + b, end - b)
        return end - begin

    def access(self, rows: np.ndarray) -> np.ndarray:
        """The symbols at the rows."""
        symbol, at = np.zeros(len(rows), np.int64), rows.copy()
        for level in range(self.bits):
            before = self.ones[level]
            one = before[at + 1] - before[at]
            symbol = symbol << 1 | one
            at = np.where(one == 1, self.zeros[level] + before[at], at - before[at])
        return symbol


class FMIndex:
    """Index of a sequence of symbols from 1 on; 0 is its end."""

    def __init__(self, symbols: np.ndarray):
        text = np.append(symbols.astype(np.int64), 0)
        order = suffix_array(text)
        marked = order % SAMPLE == 0
        self._set(text[order - 1], marked, order[marked])

    @classmethod
    def restored(cls, symbols: np.ndarray, marks: np.ndarray, places: np.ndarray) -> FMIndex:
        """The index from its parts: the symbols before the rows, which rows are marked, and the marked rows' positions."""
        index = cls.__new__(cls)
        index._set(symbols, marks, places)
        return index

    def _set(self, symbols: np.ndarray, marks: np.ndarray, places: np.ndarray) -> None:
        self.symbols, self.marks, self.places = symbols, marks, places
        self.size, self.top = len(symbols), int(symbols.max())
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=self.top + 1))))
        self.column = WaveletMatrix(symbols, max(1, self.top.bit_length()))
        self.before = np.concatenate(([0], np.cumsum(marks)))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The row ranges of patterns of one length, one pattern in a row; an empty range for what does not occur."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        alive = np.flatnonzero((patterns <= self.top).all(axis=1))
        high[(patterns > self.top).any(axis=1)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[alive, k]
            low[alive] = self.smaller[symbols] + self.column.rank(symbols, low[alive])
            high[alive] = self.smaller[symbols] + self.column.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
        low[low > high] = high[low > high]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of rows: steps back through the sequence until a marked row."""
        found, at, back = np.empty(len(rows), np.int64), rows.astype(np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            here = self.marks[at[todo]]
            done = todo[here]
            found[done] = self.places[self.before[at[done]]] + back[done]
            todo = todo[~here]
            symbols = self.column.access(at[todo])
            at[todo] = self.smaller[symbols] + self.column.rank(symbols, at[todo])
            back[todo] += 1
        return found
