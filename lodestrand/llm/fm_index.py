"""A compressed full-text index of word sequences: BWT in a wavelet matrix, and owners under range minima.

Suffixes are sorted by as many symbols as a pattern may have, which is all that backward
search needs: the suffixes that begin with a pattern are neighbours, and ranks of a symbol
before them count the suffixes that come before with the symbol put in front. The suffix
array itself isn't kept; what is asked of an interval is its least owner.
"""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence: one packed bit vector a bit of the alphabet, with counts by 64-bit word."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.levels = []
        for k in range(bits - 1, -1, -1):
            bit = (symbols >> k & 1).astype(np.uint8)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int32))).astype(np.int32)
            self.levels.append((k, words, before, len(bit) - int(before[-1])))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def places(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each position comes to stand when it follows its symbol down all levels. Less the place of position 0, that is the symbol's rank."""
        at = at.astype(np.int32)
        for k, words, before, zeros in self.levels:
            w = at >> 6
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> k & 1, zeros + ones, at - ones).astype(np.int32)
        return at


class FmIndex:
    """An index of sequences of symbols from 1 on, 0 parting them, for patterns of at most `longest` symbols; owners: a number for each place of the text."""

    def __init__(self, text: np.ndarray, sigma: int, longest: int, owners: np.ndarray) -> None:
        n = len(text)
        rank = text.astype(np.int64)
        order = np.argsort(rank, kind="stable")
        width, ranks = 1, 0
        while width < longest and ranks < n:  # rank by twice as many symbols each time
            second = np.zeros(n, np.int64)
            second[: n - width] = rank[width:] + 1
            key = rank * (int(second.max()) + 1) + second
            order = np.argsort(key, kind="stable")
            sorted_ = key[order]
            rank[order] = np.concatenate(([0], np.cumsum(sorted_[1:] != sorted_[:-1])))
            ranks = int(rank[order[-1]]) + 1
            width *= 2
        self.size = n
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma)))).astype(np.int32)
        self.bwt = WaveletMatrix(text[order - 1], max(1, int(sigma - 1).bit_length()))  # the text is a ring
        symbols = np.arange(sigma)
        self.shift = self.before[:-1] - self.bwt.places(symbols, np.zeros(sigma, np.int32))
        self.minima = [owners[order]]  # least owners of ranges of doubling width
        while 2 << len(self.minima) - 1 <= n:
            half, last = 1 << len(self.minima) - 1, self.minima[-1]
            self.minima.append(np.concatenate((np.minimum(last[:-half], last[half:]), last[-half:])))
        self.minima = np.stack(self.minima)

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner in each non-empty interval of suffixes."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        return np.minimum(self.minima[level, lo], self.minima[level, hi - (1 << level)])

    def statistics(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, below: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of streamed text at the places `end`, not beyond `begin`, against owners less than `below`: how many symbols before a place occur in a row with such an owner, and the least owner of the last `size` of them."""
        length, found = np.zeros(len(end), np.int32), np.full(len(end), np.iinfo(np.int32).max, np.int32)
        live = np.flatnonzero(end > begin)
        lo, hi, k = np.zeros(len(live), np.int32), np.full(len(live), self.size, np.int32), 0
        while len(live):
            symbol = text[end[live] - 1 - k]
            both = np.concatenate((symbol, symbol))
            both = self.bwt.places(both, np.concatenate((lo, hi))) + self.shift[both]
            lo, hi = both[: len(live)], both[len(live) :]
            some = np.flatnonzero(lo < hi)
            live, lo, hi = live[some], lo[some], hi[some]
            least = self.least(lo, hi)
            some = np.flatnonzero(least < below[live])
            live, lo, hi = live[some], lo[some], hi[some]
            k += 1
            length[live] = k
            if k == size:
                found[live] = least[some]
            some = np.flatnonzero(end[live] - k > begin[live])
            live, lo, hi = live[some], lo[some], hi[some]
        return length, found
