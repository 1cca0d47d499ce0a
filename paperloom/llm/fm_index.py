"""FM-index over words: a wavelet matrix with rank directories, and matching statistics by backward search.

One index covers the texts of one shard: their words as dense symbols, separated by
symbols below all words. Suffixes are sorted by their first DEPTH words only (prefix
doubling), which is all that patterns of up to DEPTH words need. The last column of the
sorted rotations is kept in a wavelet matrix: one bit vector per bit of the symbol, packed
in 64-bit words with a running count for rank.

Matching statistics of a streamed text: from right to left the current match is extended
to the left by backward search; when that fails, it is shortened at the right end to its
parent interval, read off the LCP array, until the extension succeeds. Many texts are
streamed at once, one lane each, so every step is a few vector operations.

An occurrence counts for a text only if it lies in a document with a smaller rank: a range-
minimum table over the suffixes' document ranks tells for any interval.
"""

from __future__ import annotations

import numpy as np

#: Longest pattern, and the longest match that is told apart.
DEPTH = 50


class WaveletMatrix:
    """Rank queries on a sequence of integers below 2**bits."""

    def __init__(self, seq: np.ndarray, bits: int):
        n = len(seq)
        self.bits, self.n = bits, n
        self.words, self.counts, self.zeros = [], [], []
        now = seq
        for level in range(bits - 1, -1, -1):
            bit = (now >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            counts = np.zeros(len(words) + 1, np.int32)
            np.cumsum(np.bitwise_count(words), out=counts[1:])
            self.words.append(words)
            self.counts.append(counts)
            self.zeros.append(n - int(counts[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        # Where each symbol's run begins in the last level depends on the symbol alone.
        symbols = np.arange(int(seq.max(initial=0)) + 1)
        self.begin = self._walk(symbols, np.zeros(len(symbols), np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each place of the sequence leads, going down the levels by the symbol's bits."""
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            q = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[i][q] + np.bitwise_count(self.words[i][q] & mask)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before lo and before hi."""
        both, start = self._walk(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])), self.begin[symbol]
        m = len(symbol)
        return both[:m] - start, both[m:] - start


class _RangeMin:
    """Sparse table of minima."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.flat = np.concatenate(self.rows)
        self.at = np.cumsum([0, *(len(r) for r in self.rows[:-1])])
        self.rows = None

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of [lo, hi), which is not empty."""
        k = np.frexp((hi - lo).astype(np.float64))[1] - 1
        base = self.at[k]
        return np.minimum(self.flat[base + lo], self.flat[base + hi - (np.int64(1) << k)])


class FMIndex:
    """Index of the texts of one shard. codes: all words; lengths: of the texts; docs: their documents' ids."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, docs: np.ndarray, depth: int = DEPTH):
        self.depth = depth
        kinds, ids = np.unique(codes, return_inverse=True)
        texts = len(lengths)
        ends = np.cumsum(lengths)
        n = len(codes) + texts
        # Every text is followed by the symbol 0; words are 1 and up.
        place = np.arange(len(codes)) + np.repeat(np.arange(texts), lengths)
        text = np.zeros(n, np.int64)
        text[place] = ids + 1
        self.starts = ends - lengths + np.arange(texts)
        # The texts are what is streamed; the index proper is the wavelet matrix, the ranks with their minima, and the LCP array.
        self.lengths, self.text = lengths, text.astype(np.int32)
        sigma = len(kinds) + 1
        sa, lcp = self._sort(text, depth)
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.first[1:])
        self.bwt = WaveletMatrix(text[sa - 1], max(1, int(sigma - 1).bit_length()))
        owner = np.repeat(np.arange(texts), lengths + 1)
        rank = np.unique(docs, return_inverse=True)[1].astype(np.int32)
        self.rank = rank
        by_suffix = rank[owner[sa]]
        by_suffix[text[sa] == 0] = np.iinfo(np.int32).max
        self.least = _RangeMin(by_suffix)
        self.lcp = lcp
        self.smaller_before, self.smaller_behind = self._smaller(lcp)
        self.n = n

    @staticmethod
    def _sort(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes sorted by their first depth symbols, LCP with the one before, at most depth).

        A match ends at a separator: a separator is never equal to another.
        """
        n = len(text)
        ranks, width = [], 1
        zero = np.flatnonzero(text == 0)
        sym = text + len(zero)
        sym[zero] = np.arange(len(zero))  # each its own symbol, in order of place
        now, sa = sym, np.argsort(sym)
        while True:
            ranks.append((width, now))
            if width >= depth:
                break
            step = min(width, depth - width)
            key = now.astype(np.int64) * (n + len(zero) + 2)
            if step < n:
                key[: n - step] += now[step:] + 1
            order = np.argsort(key)  # ties are equal in all that patterns see, so their order is free
            sorted_key = key[order]
            fresh = np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)])
            now = np.empty(n, np.int64)
            now[order] = np.cumsum(fresh)
            width += step
            sa = order
        lcp = np.zeros(n, np.int8)
        a, b = sa[:-1].copy(), sa[1:].copy()
        got = np.zeros(n - 1, np.int64)
        for w, r in reversed(ranks):
            ok = (got + w <= depth) & (a < n) & (b < n)
            ok[ok] = r[a[ok]] == r[b[ok]]
            got[ok] += w
            a[ok] += w
            b[ok] += w
        lcp[1:] = got
        return sa, lcp

    def _parent(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(interval, depth) of the longest proper prefix of each interval's pattern that has a larger interval."""
        n = self.n
        left = self.lcp[lo].astype(np.int64)
        right = np.where(hi < n, self.lcp[np.minimum(hi, n - 1)], 0).astype(np.int64)
        depth = np.maximum(left, right)
        # The side whose LCP is the depth grows to where it is below.
        return np.where(left == depth, self.smaller_before[lo], lo), np.where(right == depth, self.smaller_behind[np.minimum(hi, n - 1)], hi), depth

    @staticmethod
    def _smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest places before and behind each one with a smaller LCP; the ends where there is none."""
        before, behind = np.zeros(len(lcp), np.int32), np.full(len(lcp), len(lcp), np.int32)
        for depth in np.unique(lcp[lcp > 0]):
            here, below = np.flatnonzero(lcp == depth), np.flatnonzero(lcp < depth)
            at = np.searchsorted(below, here)
            before[here] = below[at - 1]  # the first LCP is 0
            more = at < len(below)
            behind[here[more]] = below[at[more]]
        return before, behind

    def _extend(self, symbol, lo, hi):
        a, b = self.bwt.rank(symbol, lo, hi)
        base = self.first[symbol]
        return base + a, base + b

    def matching_statistics(self, which: np.ndarray | None = None, full_only: bool = False) -> np.ndarray:
        """For each position of the texts (separators included): the longest match, up to depth, that starts
        there and occurs in a document with a smaller id. which: the texts to stream (default: all).
        full_only: only matches of the full depth are wanted; a lane ends when none can follow, and
        what it has not reached stays 0."""
        which = np.arange(len(self.lengths)) if which is None else which
        stats = np.zeros(self.n, np.int8)
        which = which[np.argsort(-self.lengths[which], kind="stable")]
        at = self.starts[which] + self.lengths[which] - 1
        begin, mine = self.starts[which], self.rank[which]
        lo = np.zeros(len(which), np.int64)
        hi = np.full(len(which), self.n, np.int64)
        depth = np.zeros(len(which), np.int64)
        while len(at):
            # A full match loses its last word before one is added; its interval grows only if it branches there.
            deep = np.flatnonzero(depth >= self.depth)
            if len(deep):
                a, b, d = self._parent(lo[deep], hi[deep])
                grown = deep[d == self.depth - 1]
                lo[grown], hi[grown] = a[d == self.depth - 1], b[d == self.depth - 1]
                depth[deep] = self.depth - 1
            todo = np.arange(len(at))
            symbol = self.text[at]
            while len(todo):
                a, b = self._extend(symbol[todo], lo[todo], hi[todo])
                good = b > a
                i = np.flatnonzero(good)
                good[i] = self.least.of(a[i], b[i]) < mine[todo[i]]
                done = todo[good]
                lo[done], hi[done] = a[good], b[good]
                depth[done] += 1
                todo = todo[~good]
                none = todo[depth[todo] == 0]
                lo[none], hi[none] = 0, self.n
                todo = todo[depth[todo] > 0]
                if full_only and len(todo):
                    # What is left of the match ends before the first window's end: no later window can be whole.
                    below = np.maximum(self.lcp[lo[todo]], np.where(hi[todo] < self.n, self.lcp[np.minimum(hi[todo], self.n - 1)], 0))
                    dead = at[todo] - begin[todo] + below + 1 < self.depth
                    depth[todo[dead]] = -1
                    todo = todo[~dead]
                if len(todo):
                    lo[todo], hi[todo], depth[todo] = self._shorten(lo[todo], hi[todo], depth[todo])
            stats[at] = np.maximum(depth, 0)
            at = at - 1
            live = (at >= begin) & (at - begin + depth + 1 >= self.depth if full_only else True) & (depth >= 0)
            if not live.all():
                at, begin, mine, lo, hi, depth = (x[live] for x in (at, begin, mine, lo, hi, depth))
        return stats

    def _shorten(self, lo, hi, depth):
        """The parent; at the root the interval of the empty pattern."""
        new_lo, new_hi, d = self._parent(lo, hi)
        d = np.minimum(d, depth - 1)
        root = d <= 0
        new_lo[root], new_hi[root], d[root] = 0, self.n, 0
        return new_lo, new_hi, d
