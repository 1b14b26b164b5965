"""Equal windows of a fixed length, found by winnowed anchors.

Every window of ``length`` elements has one anchor: the leftmost k-gram of the least hash in it. Equal
windows have equal anchors at equal offsets, so equal windows are looked for among the windows of
one anchor only. Consecutive windows with the same anchor form a run; a run that occurs elsewhere as a
whole settles all its windows at once, and only the runs at the edges of a repeat need more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import Spans, U, mix

#: Elements looked at together, windows counted once; positions take the low BITS of a sort key.
CHUNK, BITS = 1 << 20, 22
LOW = U((1 << BITS) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    n = len(x) - width + 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def chunks(first: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(row from, row to, element offset in the first row) of pieces that hold each window once: several whole rows, or part of a long one."""
    lo, rows = 0, len(first) - 1
    while lo < rows:
        if first[lo + 1] - first[lo] > CHUNK:
            for at in range(0, int(first[lo + 1] - first[lo]) - length + 1, CHUNK):
                yield lo, lo + 1, at
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + CHUNK, "right")) - 1)
        yield lo, hi, 0
        lo = hi


def runs(values: np.ndarray, first: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows: row, start (in the row), n (windows), anchor and run hash. ``first``: where each row's values begin."""
    parts = []
    for lo, hi, at in chunks(first, length):
        a = int(first[lo]) + at
        b = min(int(first[hi]), a + CHUNK + length - 1) if first[hi] - first[lo] > CHUNK and hi == lo + 1 else int(first[hi])
        if b - a < length:
            continue
        spans = Spans(values[a:b])
        grams = mix(spans.all(gram))
        key = (grams & ~LOW) | np.arange(len(grams), dtype=U)
        anchor = (sliding_min(key, length - gram + 1) & LOW).astype(np.int64)
        edge = np.clip(first[lo : hi + 1] - a, 0, b - a)
        whole = np.ones(b - a + 1, bool)  # windows that end in the row in which they begin
        if hi - lo > 1:
            step = np.zeros(b - a + 2, np.int32)
            stops = edge[1:-1]
            np.add.at(step, np.maximum(stops - length + 1, 0), 1)
            np.add.at(step, stops, -1)
            whole = np.cumsum(step)[:-1] == 0
        at_window = np.flatnonzero(whole[: len(anchor)])
        if not len(at_window):
            continue
        of = anchor[at_window]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (at_window[1:] != at_window[:-1] + 1)
        heads = np.flatnonzero(new)
        start, n = at_window[heads], np.diff(np.append(heads, len(of)))
        pos = of[heads]
        run = mix(spans.of(start, start + n - 1 + length) + mix(((pos - start).astype(U) << U(32)) | n.astype(U)))
        row = np.searchsorted(first[lo : hi + 1], start + a, "right") - 1 + lo
        parts.append((row, start + a - first[row], n, grams[pos], run))
    names = ("row", "start", "n", "anchor", "run")
    if not parts:
        return {k: np.zeros(0, np.int64 if k in ("row", "start", "n") else U) for k in names}
    return {k: np.concatenate(x) for k, x in zip(names, zip(*parts, strict=True), strict=True)}


def windows(values: np.ndarray, start: int, n: int, length: int) -> np.ndarray:
    """Hashes of the n windows of a row's values from ``start`` on."""
    return mix(Spans(values[start : start + n - 1 + length]).all(length))


def cover(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` elements some [start, end) covers."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
