"""An FM-index over integer sequences: wavelet matrix, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np

END, GAP = 0, 1  # the end of the text and a gap between its parts; words are numbered from 2


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Starts of the suffixes in order, by doubling over the groups that are not yet told apart.  ``text`` ends with its only END."""
    n = len(text)
    bits = max(1, int(sigma - 1).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([text.astype(np.int64), np.zeros(width, np.int64)])
    for j in range(width):
        key = (key << bits) | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    first = np.r_[True, key[sa][1:] != key[sa][:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    reach = width
    while True:
        alone = first & np.r_[first[1:], True]
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return sa
        items = sa[slots]
        after = items + reach
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        group = rank[items]
        order = np.lexsort((second, group))
        items, group, second = items[order], group[order], second[order]
        sa[slots] = items
        first[slots] = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        rank[items] = np.maximum.accumulate(np.where(first[slots], slots, 0))
        reach *= 2


class WaveletMatrix:
    """Ranks of symbols by one bit plane for each bit, from the highest."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        left = symbols.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            bit = (left >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]))
            self.zeros.append(len(left) - int(self.ones[-1][-1]))
            left = np.concatenate([left[bit == 0], left[bit == 1]])
        self.start = self._mapped(np.arange(sigma), np.zeros(sigma, np.int64))

    def _mapped(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.bits):
            one = self.ones[k][at]
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, self.zeros[k] + one, at - one)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``, for arrays of both."""
        return self._mapped(symbol, at) - self.start[symbol]


class FMIndex:
    """Index of a sequence of word numbers (from 2) and GAPs; END is appended here."""

    def __init__(self, text: np.ndarray, sigma: int, step: int = 8):
        text = np.concatenate([text, [END]]).astype(np.int32)
        sa = suffix_array(text, sigma)
        self.last = text[sa - 1]
        self.tree = WaveletMatrix(self.last, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.marked = sa % step == 0
        self.sampled = sa[self.marked]
        self.number = np.cumsum(self.marked) - 1

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that start with each phrase; ``phrases`` is right-aligned."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        width = phrases.shape[1]
        for back in range(1, width + 1):
            live = np.flatnonzero((high > low) & (lengths >= back))
            if not len(live):
                break
            symbol = phrases[live, width - back]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk to the left until a sampled one."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            done = self.marked[at]
            out[left[done]] = self.sampled[self.number[at[done]]] + steps
            left, at = left[~done], at[~done]
            symbol = self.last[at]
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out
