"""An FM-index over a shard's words, with arrays instead of loops.

Symbols are numbers: 0 separates (a document's end, or words that no phrase has), the
rest are words. Each separator sorts before every word and differs from all others, so
equal stretches end at the next separator and sorting suffixes takes few rounds. The
Burrows-Wheeler transform lies in a wavelet matrix, which answers how often a word
occurs before a row. All phrases are searched backwards at once.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8      # every so many positions, and every position after a separator, is stored


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; only suffixes still tied are sorted again."""
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    new = np.ones(n, bool)
    new[1:] = sorted_rank[1:] != sorted_rank[:-1]
    group = np.flatnonzero(new)[np.cumsum(new) - 1]           # first row of each row's group
    place = np.empty(n + 1, np.int64)
    place[n] = -1                                             # past the end sorts first
    place[order] = group
    k = 1
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        at = order[tied]
        head = place[at]
        tail = place[np.minimum(at + k, n)]
        by = np.lexsort((tail, head))
        at, head, tail = at[by], head[by], tail[by]
        order[tied] = at
        first = np.ones(len(at), bool)
        first[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
        place[at] = tied[np.flatnonzero(first)[np.cumsum(first) - 1]]
        tied = tied[~(first & np.append(first[1:], True))]
        k *= 2
    return order


class FMIndex:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        """``symbols`` ends with a separator (0); words are 1 to ``n_symbols`` - 1."""
        separators = symbols == 0
        m = int(separators.sum())
        rank = np.where(separators, np.cumsum(separators) - 1, symbols + m - 1)
        suffixes = suffix_array(rank)
        before = symbols[suffixes - 1]                        # the last symbol comes before the first
        self.n, self.bwt = len(symbols), before
        counts = np.bincount(symbols, minlength=n_symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.sampled = (before == 0) | (suffixes % SAMPLE == 0)
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = suffixes[self.sampled]
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros, level = [], [], before
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        everything = np.arange(n_symbols)
        self.base = self.first[:-1] - self._down(everything, np.zeros(n_symbols, np.int64))

    def _down(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            r = ones[row]
            row = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + r, row - r)
        return row

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Rows of suffixes that begin with ``symbol`` before those that ``row`` counts."""
        return self.base[symbol] + self._down(symbol, row)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (one a row, right-aligned) that occur: index, first row, row after last."""
        at = np.arange(len(phrases))
        last = phrases[:, -1]
        low, high = self.first[last], self.first[last + 1]
        done = []
        for i in range(1, phrases.shape[1] + 1):
            alive = low < high
            at, low, high = at[alive], low[alive], high[alive]
            ended = lengths[at] == i
            done.append((at[ended], low[ended], high[ended]))
            at, low, high = at[~ended], low[~ended], high[~ended]
            if not len(at):
                break
            symbol = phrases[at, phrases.shape[1] - 1 - i]
            low, high = self.step(symbol, low), self.step(symbol, high)
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of every row of each range, and the range each belongs to."""
        n = high - low
        which = np.repeat(np.arange(len(low)), n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]
        position = np.full(len(row), -1, np.int64)
        left, steps = np.arange(len(row)), 0
        while len(left):
            hit = self.sampled[row]
            position[left[hit]] = self.samples[self.sample_no[row[hit]]] + steps
            left, row, steps = left[~hit], row[~hit], steps + 1
            row = self.step(self.bwt[row], row)
        return position, which
