"""A full-text index over integer words: a wavelet matrix over the Burrows-Wheeler transform.

What it keeps of its sequences are the matrix' bit rows, one for each bit of a word's
number, and of every group of suffixes with the same first words where it begins and
the least mark of its sequences; no text, no suffix array.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_array(codes: np.ndarray, depth_kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of sequences that each end with code 0, in order; and the ranks at depth ``depth_kept``, a power of two, or at the last depth.

    A comparison ends with a sequence's 0; equal suffixes stand in order of position.
    """
    n = len(codes)
    place = np.arange(n, dtype=np.int32)
    ends = np.flatnonzero(codes == 0).astype(np.int32)
    left = ends[np.searchsorted(ends, place)] - place + 1  # words to the end of the sequence, its 0 included
    rank = codes.astype(np.int64)
    kept, depth, longest = rank.astype(np.int32), 1, int(left.max())
    while depth < longest:
        ahead = np.zeros(n, np.int64)
        inside = np.flatnonzero(left > depth)
        ahead[inside] = rank[inside + depth] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key)
        rank[order] = np.cumsum(np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)]))
        depth *= 2
        if depth <= depth_kept:
            kept = rank.astype(np.int32)
    return np.argsort(rank, kind="stable").astype(np.int32), kept


class WaveletMatrix:
    """Packed bit rows, one for each bit of a symbol, with counts at every 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.rows: list[tuple[np.ndarray, np.ndarray, int]] = []
        now = symbols
        for b in range(bits - 1, -1, -1):
            bit = (now >> b & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            packed = np.packbits(padded, bitorder="little").view(U64)
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])
            self.rows.append((packed, counts, self.n - int(bit.sum())))
            now = np.concatenate([now[~bit], now[bit]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` falls among each symbol's own entries on the last level."""
        for level, (packed, counts, zeros) in enumerate(self.rows):
            word, rest = at >> 6, (at & 63).astype(U64)
            ones = counts[word] + np.bitwise_count(packed[word] & ((U64(1) << rest) - U64(1)))
            at = np.where(symbols >> (self.bits - 1 - level) & 1, zeros + ones, at - ones)
        return at


class FMIndex:
    """Backward search over sequences of words, with suffixes grouped by their first ``length`` words."""

    def __init__(self, sequences: list[np.ndarray], length: int, marks: list[int] | None = None):
        """sequences: non-empty arrays of word hashes; marks: a number for each, 0 without."""
        sizes = np.array([len(s) for s in sequences])
        self.words, inverse = np.unique(np.concatenate(sequences), return_inverse=True)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        codes = np.zeros(int(sizes.sum()) + len(sizes), np.int32)
        kept = np.ones(len(codes), bool)
        kept[begins + sizes] = False
        codes[kept] = inverse + 1
        self.size, self.length = len(codes), length
        half = 1 << max(0, (length - 1).bit_length() - 1)
        suffixes, ranks = suffix_array(codes, half)
        bwt = codes[suffixes - 1]
        bwt[suffixes == 0] = 0
        self.matrix = WaveletMatrix(bwt, max(1, int(len(self.words)).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.words) + 1))])
        every = np.arange(len(self.words) + 1)
        self.origin = self.matrix.descend(every, np.zeros(len(every), np.int64))
        # the first ``length`` words are equal if the first ``half`` and the ``half`` before place ``length`` are
        later = np.minimum(suffixes + (length - half), len(codes) - 1)
        a, b = ranks[suffixes], ranks[later]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.group_first = np.concatenate([np.flatnonzero(new), [len(codes)]])
        owner = np.repeat(np.array(marks or [0] * len(sequences), np.int64), sizes + 1)
        self.least = np.minimum.reduceat(owner[suffixes], self.group_first[:-1])

    def step(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row before which the suffixes ``code`` + (rows before ``at``) end."""
        return self.first[code] + self.matrix.descend(code, at) - self.origin[code]

    def stream(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """For each sequence: the group of the suffixes that match ``length`` words from each position, or -1.

        All sequences go from right to left together.  An interval of rows is extended
        by one word; beyond ``length`` words it widens to its group again, so the match
        keeps that length.  Where no row remains, the sequence leaves this pass: the words
        that failed are in no match, and windows before their end are searched one by one.
        """
        count = len(sequences)
        sizes = np.array([len(s) for s in sequences])
        grid_at = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.concatenate(sequences)
        found = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
        code = np.where(self.words[found] == flat, found + 1, -1)
        groups = np.full(len(flat), -1, np.int32)
        low, high, have = np.zeros(count, np.int64), np.full(count, self.size), np.zeros(count, np.int64)
        alive, pending = np.ones(count, bool), []
        order = np.argsort(-sizes, kind="stable")
        for t in range(int(sizes.max())):
            lanes = order[: int(np.searchsorted(-sizes[order], -t, "left"))]
            lanes = lanes[alive[lanes]]
            at = grid_at[lanes] + sizes[lanes] - 1 - t
            lo, hi, known = low[lanes], high[lanes], code[at] > 0
            lo[known], hi[known] = self.step(code[at[known]], lo[known]), self.step(code[at[known]], hi[known])
            lost = ~known | (lo >= hi)
            alive[lanes[lost]] = False
            pending += [np.arange(grid_at[i], min(a, a + have[i] - self.length) + 1) for i, a in zip(lanes[lost], at[lost], strict=True)]
            lanes, at = lanes[~lost], at[~lost]
            low[lanes], high[lanes] = lo[~lost], hi[~lost]
            have[lanes] += 1
            full = have[lanes] >= self.length
            g, go = np.searchsorted(self.group_first, low[lanes[full]], "right") - 1, lanes[full]
            low[go], high[go], have[go] = self.group_first[g], self.group_first[g + 1], self.length
            groups[at[full]] = g
        starts = np.concatenate(pending) if pending else np.zeros(0, np.int64)
        for a in range(0, len(starts), 1 << 18):
            self._windows(code, starts[a : a + (1 << 18)], groups)
        return [groups[a:b] for a, b in zip(grid_at, grid_at[1:], strict=False)]

    def _windows(self, code: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> None:
        """Backward search of the windows that begin at ``starts``, all together; their groups go into ``groups``."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size)
        for j in range(self.length - 1, -1, -1):
            c = code[starts + j]
            there = c > 0
            starts, low, high, c = starts[there], low[there], high[there], c[there]
            low, high = self.step(c, low), self.step(c, high)
            there = low < high
            starts, low, high = starts[there], low[there], high[there]
        groups[starts] = np.searchsorted(self.group_first, low, "right") - 1
