"""A compressed FM-index over integer sequences, searched by many streams in step.

The text's suffixes are sorted by their first 64 symbols, by prefix doubling. The Burrows-Wheeler transform is kept in a wavelet
matrix, one bit vector a level with a count every 64 bits. Backward search takes all streams one symbol to the left at a time, and
where a stream's interval would become empty, its match loses symbols at its right end until it can go on: the lengths found
on the way are the matching statistics, here up to a cap.
"""

from __future__ import annotations

import numpy as np

DEPTH = 64


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before each i."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for bit in reversed(range(max(1, int(sigma - 1).bit_length()))):
            ones = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, BitVector(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.base = np.zeros(sigma, np.int64)
        self.base = self.rank(np.arange(sigma), np.zeros(sigma, np.int64))

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each i."""
        first = i
        for bit, ones, zeros in self.levels:
            before = ones.rank(i)
            i = np.where(symbols >> bit & 1, zeros + before, i - before)
        return i - self.base[symbols] if len(first) else i


class FMIndex:
    """``symbols`` are 1 and up within sequences; ``bounds`` the n + 1 bounds of the sequences; ``values`` one number a sequence."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, values: np.ndarray, cap: int):
        if not 0 < cap < DEPTH:
            raise ValueError(f"the cap of matches must be from 1 to {DEPTH - 1}")
        self.cap = cap
        sizes = np.diff(bounds)
        # Each sequence is followed by a 0, which no pattern has.
        text = np.insert(symbols.astype(np.int64), bounds[1:], 0)
        n = self.size = len(text)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        ranks = [np.unique(text, return_inverse=True)[1]]
        depth = 1
        while depth < DEPTH:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - depth)] = ranks[-1][depth:] + 1
            ranks.append(np.unique(ranks[-1].astype(np.int64) * (n + 1) + ahead, return_inverse=True)[1])
            depth *= 2
        suffixes = np.argsort(ranks[-1], kind="stable")
        a, b = suffixes[:-1], suffixes[1:]
        common = np.zeros(max(0, n - 1), np.int64)
        for k in reversed(range(len(ranks))):
            i, j = a + common, b + common
            fits = (i < n) & (j < n)
            same = np.zeros(len(common), bool)
            same[fits] = ranks[k][i[fits]] == ranks[k][j[fits]]
            common[same] += 1 << k
        #: Common prefix, up to DEPTH, of each suffix and the one before; the ends share nothing.
        self.common = np.concatenate([[-1], np.minimum(common, DEPTH), [-1]])
        self.sigma = int(text.max(initial=0)) + 1
        self.starts = np.searchsorted(np.sort(text), np.arange(self.sigma + 1))
        self.transform = WaveletMatrix(text[suffixes - 1], self.sigma)
        self._cuts: dict[int, np.ndarray] = {}
        groups = self.cuts(cap)[:-1]
        self.least = np.minimum.reduceat(values[owner][suffixes], groups) if n else values[:0]

    def cuts(self, depth: int) -> np.ndarray:
        """Where suffixes differ from the one before within the first ``depth`` symbols."""
        if depth not in self._cuts:
            self._cuts[depth] = np.flatnonzero(self.common < depth)
        return self._cuts[depth]

    def _widen(self, lo: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all suffixes that share ``depth`` symbols with the one at ``lo``."""
        out_lo, out_hi = lo.copy(), lo.copy()
        for d in np.unique(depth):
            own = depth == d
            cuts = self.cuts(int(d))
            at = np.searchsorted(cuts, lo[own], "right")
            out_lo[own], out_hi[own] = cuts[at - 1], cuts[at]
        return out_lo, out_hi

    def match(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the streams: the length, up to the cap, of the longest match that starts there, and the
        least value of all sequences that hold it where the length is the cap (else the largest integer)."""
        n = self.size
        lengths = np.zeros(len(symbols), np.int64)
        least = np.full(len(symbols), np.iinfo(np.int64).max)
        if not n or not len(symbols):
            return lengths, least
        sizes = np.diff(bounds)
        order = np.argsort(-sizes, kind="stable")
        ends, sizes = bounds[1:][order], sizes[order]
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), n, np.int64)
        length = np.zeros(len(order), np.int64)
        group_at = self.cuts(self.cap)
        for step in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -step, "left"))
            at = ends[:live] - 1 - step
            symbol = symbols[at]
            todo = np.arange(live)
            unknown = (symbol < 1) | (symbol >= self.sigma)
            lo[:live][unknown], hi[:live][unknown], length[:live][unknown] = 0, n, 0
            todo = todo[~unknown]
            while len(todo):
                s = symbol[todo]
                new_lo = self.starts[s] + self.transform.rank(s, lo[todo])
                new_hi = self.starts[s] + self.transform.rank(s, hi[todo])
                good = new_lo < new_hi
                own = todo[good]
                lo[own], hi[own] = new_lo[good], new_hi[good]
                length[own] += 1
                todo = todo[~good]
                todo = todo[length[todo] > 0]  # a symbol that the text has always extends the empty match
                if len(todo):
                    shorter = np.maximum(self.common[lo[todo]], self.common[hi[todo]])
                    length[todo] = np.maximum(shorter, 0)
                    lo[todo], hi[todo] = self._widen(lo[todo], length[todo])
            over = np.flatnonzero(length[:live] > self.cap)
            if len(over):
                length[over] = self.cap
                lo[over], hi[over] = self._widen(lo[over], length[over])
            lengths[at] = length[:live]
            full = np.flatnonzero(length[:live] == self.cap)
            least[at[full]] = self.least[np.searchsorted(group_at, lo[full], "right") - 1]
        return lengths, least
