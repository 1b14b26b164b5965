"""Counts of whole texts, a batch at a time: words, lines, symbols and repeats."""

from __future__ import annotations

import numpy as np

from .winnow import cover
from .words import exact_ids, split_words

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?"]] = True


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def distinct_per_row(row: np.ndarray, ids: np.ndarray, rows: int) -> np.ndarray:
    """How many different ids each row has."""
    keys = np.sort(row * (int(ids.max(initial=0)) + 1) + ids)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.bincount(keys[new] // (int(ids.max(initial=0)) + 1), minlength=rows)


class Stats:
    """All counts are arrays with one entry a text."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        rows = len(off) - 1
        self.buf, self.off = buf, off
        self.starts, self.ends, self.first = split_words(buf, off)
        self.words = exact_ids(buf, self.starts, self.ends)[0]  # equal words alone have equal numbers
        self.n_bytes = np.diff(off)
        self.n_words = np.diff(self.first)
        self.row = np.repeat(np.arange(rows), self.n_words)
        turn = np.zeros(len(buf) + 1, np.int8)
        turn[self.starts] = 1
        turn[self.ends] -= 1
        within = np.cumsum(turn[:-1], dtype=np.int8).view(bool)
        self.word_chars = per_row(within & ((buf & 0xC0) != 0x80), off)
        self.n_symbols = per_row(SYMBOL[buf], off)
        self.n_dup_lines, self.n_lines = self._lines()
        self.n_repeat_words = self._repeats(5)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        breaks = np.flatnonzero(self.buf == 10)
        begin = np.concatenate([self.off[:-1], breaks + 1])
        begin.sort()
        end = np.concatenate([self.off[1:], breaks])
        end.sort()
        rows = len(self.off) - 1
        row = np.searchsorted(self.off, begin, "right") - 1
        held = np.searchsorted(self.starts, end) > np.searchsorted(self.starts, begin)
        begin, end, row = begin[held], end[held], row[held]
        n = np.bincount(row, minlength=rows)
        return n - distinct_per_row(row, exact_ids(self.buf, begin, end)[0], rows), n

    def _repeats(self, size: int) -> np.ndarray:
        n = len(self.words) - size + 1
        if n <= 0:
            return np.zeros(len(self.off) - 1, np.int64)
        # numbers of longer and longer sequences, each made of two overlapping ones of one word less: exact at every length
        base = int(self.words.max()) + 1
        whole = np.flatnonzero(self.row[size - 1 :] == self.row[:n])
        key = self.row[whole] * base + self.words[whole]
        for j in range(1, size):
            key = np.unique(key, return_inverse=True)[1] * base + self.words[whole + j]
        _, key, count = np.unique(key, return_inverse=True, return_counts=True)
        at = whole[count[key] > 1]
        return per_row(cover(len(self.words), at, at + size), self.first)

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 10) | (100 * self.n_repeat_words > 20 * self.n_words)

    def ratios(self) -> np.ndarray:
        """A row of shape features for each text, all finite; none depends on the language or the order of texts."""
        n = np.maximum(self.n_words, 1)
        size = np.maximum(self.n_bytes, 1)
        rows = len(self.off) - 1
        same_next = np.zeros(len(self.words), bool)
        if len(self.words) > 1:
            same_next[:-1] = (self.words[1:] == self.words[:-1]) & (self.row[1:] == self.row[:-1])
        stops = STOP[self.buf[self.ends - 1]] if len(self.ends) else np.zeros(0, bool)
        return np.column_stack(
            [
                np.minimum(self.n_symbols / n, 2),
                np.minimum(self.n_symbols / n, 0.1) * 10,
                self.n_repeat_words / n,
                self.n_dup_lines / np.maximum(self.n_lines, 1),
                np.log1p(self.n_words),
                self.n_words < 10,
                distinct_per_row(self.row, self.words, rows) / n,
                np.minimum(self.word_chars / n, 30) / 10,
                per_row(same_next, self.first) / n,
                per_row(DIGIT[self.buf], self.off) / size,
                per_row(UPPER[self.buf], self.off) / n,
                per_row(stops, self.first) / n,
                per_row(self.buf >= 0xC0, self.off) / size,
            ]
        ).astype(np.float64)
