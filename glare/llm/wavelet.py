"""Wavelet matrix over the character classes of UTF-8 text.

Every byte gets one of eight classes; the classes are stored as three bit
vectors with rank directories. A rank query counts a class before a position by
one lookup a level; counts of several classes are combined into the number of
units (characters, words, lines) that start before it, and bisection on that
count finds where a unit starts. All queries take arrays of positions.
"""
from __future__ import annotations

import numpy as np

#: classes: inner byte of a character; white space; visible character inside a
#: word; one that opens a word; white space that opens a line; a visible
#: character that opens a line (and a word)
INNER, SPACE, VISIBLE, WORD, LINE_SPACE, LINE_WORD = 0, 1, 2, 3, 4, 5
LEVELS = 3
#: classes that start a unit of each kind
UNITS = {
    "char": (SPACE, VISIBLE, WORD, LINE_SPACE, LINE_WORD),
    "word": (WORD, LINE_WORD),
    "line": (LINE_SPACE, LINE_WORD),
}

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of every byte of ``data``; texts begin at ``starts``, where a line begins too."""
    white = _WHITE[data]
    after_white, opens_line = np.empty(len(data), bool), np.empty(len(data), bool)
    after_white[1:], opens_line[1:] = white[:-1], data[:-1] == 0x0A
    begin = starts[starts < len(data)]
    after_white[begin] = opens_line[begin] = True
    out = np.where(white, np.where(opens_line, LINE_SPACE, SPACE),
                   np.where(opens_line, LINE_WORD, np.where(after_white, WORD, VISIBLE))).astype(np.uint8)
    out[(data & 0xC0) == 0x80] = INNER
    return out


class _Bits:
    """Bit vector with rank: 64-bit words and the ones before each of them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(packed) // 8 + 1, "<u8")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        inside = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside)


class WaveletMatrix:
    """Symbols below 2 ** levels, highest bit first; at each level zeros move before ones."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.n, self.levels = len(symbols), []
        for shift in range(levels - 1, -1, -1):
            bits = (symbols >> shift) & 1 == 1
            self.levels.append((_Bits(bits), self.n - int(np.count_nonzero(bits))))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def count(self, wanted, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many symbols among ``wanted`` lie in each [lo, hi): a subtree that
        is wanted whole is counted by its width, one not wanted at all is left."""
        wanted = frozenset(wanted)

        def below(level, first, lo, hi):
            size = 1 << (len(self.levels) - level)
            inside = sum(first <= s < first + size for s in wanted)
            if inside == 0:
                return 0
            if inside == size:
                return hi - lo
            bits, zeros = self.levels[level]
            a, b = bits.ones(lo), bits.ones(hi)
            return (below(level + 1, first, lo - a, hi - b)
                    + below(level + 1, first + size // 2, zeros + a, zeros + b))

        return below(0, 0, np.asarray(lo, np.int64), np.asarray(hi, np.int64)) + np.zeros(len(lo), np.int64)

    def cut_after(self, wanted, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The largest position in [lo, hi] with at most ``k`` units before it: where
        unit k (from 0) starts, or ``hi`` if there are no more than k."""
        a, b = np.array(lo, np.int64), np.array(hi, np.int64)
        while (a < b).any():
            mid = (a + b + 1) >> 1
            few = self.count(wanted, lo, mid) <= k
            a, b = np.where(few, mid, a), np.where(few, b, mid - 1)
        return a
