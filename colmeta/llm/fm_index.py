"""An FM-index over segments of words: the Burrows-Wheeler transform in a wavelet matrix, searched backward."""

from __future__ import annotations

import numpy as np

from .suffixes import suffix_order


class _Bits:
    """A bit vector with counts of ones before each 64 bits."""

    __slots__ = ("before", "words")

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & mask)


class FMIndex:
    """Counts how often sequences of symbols occur in a text. The text is kept as wavelet bits only."""

    def __init__(self, segments: np.ndarray, at: np.ndarray) -> None:
        """segments: symbols (from 1) of all segments, one after another; at: where each starts, and the end."""
        many = len(at) - 1
        n = len(segments) + many
        ends = at[1:] + np.arange(many)  # a separator behind each segment
        inside = np.ones(n, bool)
        inside[ends] = False
        symbols = np.zeros(n, np.int64)
        symbols[inside] = segments
        apart = symbols + (many - 1)  # separators differ from one another in the order of suffixes
        apart[ends] = np.arange(many)
        width = int(apart.max(initial=0)) + 1
        key, length = apart, 1
        while width ** (length + 1) < 1 << 62 and length < 3:
            key = key * width + np.r_[apart[length:], np.zeros(min(length, n), np.int64)][:n]
            length += 1
        order, _ = suffix_order(key, length, keep=False)
        transform = symbols[order - 1]
        self.size = n
        self.below = np.r_[0, np.cumsum(np.bincount(symbols))]  # symbols less than each
        self.levels: list[tuple[int, _Bits, int]] = []
        for b in range(max(int(symbols.max(initial=0)).bit_length(), 1) - 1, -1, -1):
            bits = (transform >> b) & 1
            ones = bits == 1
            transform = np.concatenate([transform[~ones], transform[ones]])
            self.levels.append((b, _Bits(bits), n - int(ones.sum())))
        self.first = self._down(np.arange(len(self.below) - 1), np.zeros(len(self.below) - 1, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, bits, zeros in self.levels:
            ones = bits.ones(i)
            i = np.where((symbol >> b) & 1 == 1, zeros + ones, i - ones)
        return i

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of each symbol followed by what the interval stands for."""
        both = self._down(np.r_[symbol, symbol], np.r_[low, high])
        base = self.below[symbol] - self.first[symbol]
        return both[: len(low)] + base, both[len(low) :] + base


def repeated_intervals(index: FMIndex, text: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of `least` symbols and more that occur twice in the index, of segments text[start:end].

    Returns each interval's segment, start and end. All segments are streamed at once: each holds an end e and is searched
    backward from it until what is read occurs once. If that is [x, e), no interval that holds x and ends at e or behind
    is repeated, so the next end is the last of a window that starts at x or before: e - 1, or the end of x's window.
    """
    who = np.flatnonzero(end - start >= least)
    e, first = end[who].copy(), start[who]
    x = e.copy()
    low, high = np.zeros(len(who), np.int64), np.full(len(who), index.size)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(who):
        more = x > first
        new_low, new_high = index.extended(text[np.maximum(x - 1, first)], low, high)
        more &= new_high - new_low >= 2
        x = np.where(more, x - 1, x)
        low, high = np.where(more, new_low, 0), np.where(more, new_high, index.size)
        if more.all():
            continue
        hit = ~more & (e - x >= least)
        if hit.any():
            found.append((who[hit], x[hit], e[hit]))
        e = np.where(more, e, np.minimum(e - 1, x + least - 1))
        x = np.where(more, x, e)
        live = e - first >= least
        if not live.all():
            who, e, first, x, low, high = (v[live] for v in (who, e, first, x, low, high))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))
