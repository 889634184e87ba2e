"""A compressed FM-index over word sequences, through which other sequences are streamed.

The text is a list of sequences of word hashes, separated by a sign that no
search uses.  Its transform lies in a wavelet matrix of bit-packed levels with
ranks; the text itself is not kept.  Beside it are the lengths that neighbouring suffixes share
(LCP), with the places of the next smaller ones, and minima of the sequences' values over
short runs of suffixes.

`matching` streams sequences through the index from right to left, all in lockstep, and
gives their matching statistics: for each place the length of the longest match
with an indexed sequence of a smaller value.  A step extends the matches by one sign (backward
search); a match that cannot be extended is cut back to the next shorter one that has more
occurrences (the parent interval of its suffixes).  Matches below a threshold are not
told apart from matches with any sequence, as nobody asks for them.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


class WaveletMatrix:
    """Ranks of signs below 2 ** levels in a sequence, from one bit per sign and level and a 32-bit count per 64 bits."""

    def __init__(self, signs: np.ndarray, levels: int):
        self.size, self.levels = len(signs), levels
        self.bits, self.ranks, self.zeros = [], [], []
        rest = signs
        for level in range(levels - 1, -1, -1):
            bit = (rest >> level) & 1
            packed = np.packbits(np.concatenate([bit, np.zeros(64 - len(bit) % 64, bit.dtype)]).astype(np.uint8), bitorder="little").view(np.uint64)
            ones = np.bitwise_count(packed).astype(np.int64)
            self.bits.append(packed)
            self.ranks.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.base = self._down(np.arange(1 << levels), np.zeros(1 << levels, dtype=np.int64))

    def _down(self, signs: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            block, bit = at >> 6, (at & 63).astype(np.uint64)
            ones = self.ranks[k][block] + np.bitwise_count(self.bits[k][block] & ((_U(1) << bit) - _U(1))).astype(np.int64)
            at = np.where((signs >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, signs: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each sign is in the first `at` places."""
        return self._down(signs, at) - self.base[signs]


class FmIndex:
    """Index of sequences; `values` gives a number to each, of which searches return the least."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, values: np.ndarray, threshold: int):
        if threshold < 1:
            raise ValueError("a threshold is at least one word")
        self.threshold = threshold
        self.signs, ids = np.unique(hashes, return_inverse=True)
        n = len(hashes) + len(lengths)
        text = np.zeros(n, dtype=np.int32)
        inside = np.ones(n, dtype=bool)
        inside[np.cumsum(lengths + 1) - 1] = False  # places of the separators
        text[inside] = ids + 1
        sigma = len(self.signs) + 1
        order, ranks = self._sorted(text, int(lengths.max(initial=0)) + 1)
        self.size = n
        self.wavelet = WaveletMatrix(text[order - 1], max(1, (sigma - 1).bit_length()))
        counts = np.bincount(text, minlength=sigma)
        self.before = np.cumsum(counts) - counts
        self.shared = self._shared(order, ranks, n)
        del ranks, text
        self.left, self.right = self._smaller(self.shared)
        self._minima(np.repeat(values, lengths + 1)[order])

    @staticmethod
    def _sorted(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffixes by their first `depth` signs or more, and the ranks of all places by their first 1, 2, 4, ... signs."""
        ranks, step = [text], 1
        while True:
            rank = ranks[-1].astype(np.int64)
            key = rank * (int(rank.max(initial=0)) + 2)
            key[: len(key) - step] += rank[step:] + 1
            order = np.argsort(key)
            step *= 2
            if step >= depth:
                return order, ranks
            sorted_key = key[order]
            rank = np.empty(len(text), dtype=np.int32)
            if len(text):
                rank[order] = np.cumsum(np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]]))
            ranks.append(rank)

    @staticmethod
    def _shared(order: np.ndarray, ranks: list[np.ndarray], n: int) -> np.ndarray:
        """Signs that each suffix shares with the one before it, as far as the order tells; -1 at both ends."""
        out = np.full(n + 1, -1, dtype=np.int32)
        if n:
            out[1:n] = 0
            a, b = order[:-1].copy(), order[1:].copy()
            for k in (len(ranks) - 1, *range(len(ranks) - 1, -1, -1)):  # the longest step twice: the order goes twice as deep
                on = np.flatnonzero((a < n) & (b < n))
                on = on[ranks[k][a[on]] == ranks[k][b[on]]]
                out[1 + on] += 1 << k
                a[on] += 1 << k
                b[on] += 1 << k
        return out

    @staticmethod
    def _smaller(shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest place before and after each with a smaller value; pointers jump over pointers, so rounds are few."""
        out = []
        for values in (shared, shared[::-1]):
            at = np.arange(len(values), dtype=np.int32) - 1
            at[0] = 0
            on = np.flatnonzero((values[at] >= values) & (np.arange(len(values)) > 0) & (values > -1))
            while len(on):
                at[on] = at[at[on]]
                on = on[values[at[on]] >= values[on]]
            out.append(at)
        return out[0], (len(shared) - 1 - out[1])[::-1].astype(np.int32)

    def _minima(self, values: np.ndarray) -> None:
        """Least value of every 1, 2, 4, ... neighbouring suffixes, up to the longest run that a match at the threshold can have."""
        deep = np.concatenate([[False], self.shared[1:-1] >= self.threshold, [False]]).astype(np.int8) if self.size > 1 else np.zeros(2, np.int8)
        edges = np.flatnonzero(np.diff(deep))
        longest = int((edges[1::2] - edges[::2]).max(initial=0)) + 1
        self.distinct, ranks = np.unique(values, return_inverse=True)
        self.least = [ranks.astype(np.int32)]
        while 1 << len(self.least) <= longest:
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[: len(last) - step], last[step:]))

    def minimum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rank of the least value in intervals of suffixes that match the threshold; len(distinct) in empty ones."""
        out = np.full(len(low), len(self.distinct), dtype=np.int64)
        size = high - low
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        for k in np.unique(level[size > 0]):
            on = np.flatnonzero((level == k) & (size > 0))
            out[on] = np.minimum(self.least[k][low[on]], self.least[k][high[on] - (1 << int(k))])
        return out

    def _back(self, signs: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search."""
        both = self.wavelet.rank(np.concatenate([signs, signs]), np.concatenate([low, high]))
        return self.before[signs] + both[: len(signs)], self.before[signs] + both[len(signs) :]

    def matching(self, hashes: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Matching statistics of streamed sequences, one after the other: at each place the length of the longest match with an indexed
        sequence of a smaller value than the streamed one's; lengths below the threshold are those of matches with any, or less."""
        place = np.searchsorted(self.signs, hashes)
        place[place == len(self.signs)] = 0
        sign = np.where(self.signs[place] == hashes, place + 1, 0) if len(self.signs) else np.zeros(len(hashes), np.int64)
        own = np.searchsorted(self.distinct, values)
        ends = np.cumsum(lengths)
        order = np.argsort(-lengths, kind="stable")
        found = np.zeros(len(hashes), dtype=np.int32)
        low, high, length = np.zeros(len(order), np.int64), np.full(len(order), self.size, np.int64), np.zeros(len(order), np.int64)
        sorted_lengths, sorted_ends = lengths[order], ends[order]
        for step in range(1, int(lengths.max(initial=0)) + 1):
            on = np.arange(int(np.searchsorted(-sorted_lengths, -step, side="right")))
            at = sorted_ends[on] - step
            pending = on
            while len(pending):
                signs = sign[at[pending]]
                a, b = self._back(signs, low[pending], high[pending])
                fits = (b > a) & (signs > 0)
                strict = fits & (length[pending] + 1 >= self.threshold)
                fits[strict] = self.minimum(a[strict], b[strict]) < own[order[pending[strict]]]
                good = pending[fits]
                low[good], high[good] = a[fits], b[fits]
                length[good] += 1
                bad = pending[~fits]
                # A match without a sign cannot be cut back: it stays empty.
                start = bad[(length[bad] == 0) | (sign[at[bad]] == 0)]
                low[start], high[start], length[start] = 0, self.size, 0
                bad = bad[(length[bad] > 0) & (sign[at[bad]] > 0)]
                self._cut(bad, low, high, length)
                pending = bad
            found[at] = length[on]
        return found

    def _cut(self, which: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> None:
        """Cuts matches back to the parent of their interval, but a match that is long enough to be restricted not below the longest that is not."""
        a, b = low[which], high[which]
        depth = np.maximum(np.maximum(self.shared[a], self.shared[b]), 0).astype(np.int64)
        free = np.maximum(self.threshold - 2, 0)
        held = (length[which] > free) & (depth < free)
        length[which] = np.where(held, free, depth)
        at = np.where(self.shared[a] >= self.shared[b], a, b)
        up_low, up_high = np.where(depth == 0, 0, self.left[at]), np.where(depth == 0, self.size, self.right[at])
        # An interval stands for all lengths down to its parent's: a match that is held keeps it.
        low[which], high[which] = np.where(held, a, up_low), np.where(held, b, up_high)
