"""Texts of a batch as flat arrays: words, and 64-bit hashes of words and of spans by prefix sums.

A word is a run of bytes other than space and U+0009 to U+000D, so UTF-8 bytes serve as well as characters.
A word's hash is its XXH64. A span's hash is made of two sums of its elements' values times powers of a base,
modulo the prime 2**31 - 1, each with its own base; prefix sums give any span in constant time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

PRIME = U((1 << 31) - 1)
#: Bases of the two sums and their inverses.
_BASES = (0x2545F491, 0x5851F42D)
_INVERSES = tuple(pow(b, -1, int(PRIME)) for b in _BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A value for each byte.
BYTE_VALUE = mix((np.arange(1, 257, dtype=U)) * U(0xD1B54A32D192ED03))
_powers: list[list[np.ndarray]] = [[np.ones(1, U), np.ones(1, U)], [np.ones(1, U), np.ones(1, U)]]


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the lane's base and of its inverse."""
    for k, base in enumerate((_BASES[lane], _INVERSES[lane])):
        x = _powers[lane][k]
        while len(x) < n:
            x = np.concatenate([x, x * U(pow(base, len(x), int(PRIME))) % PRIME])
        _powers[lane][k] = x
    up, down = _powers[lane]
    return up[:n], down[:n]


class Spans:
    """62-bit hashes of spans of one sequence of 64-bit values; sums stay below 2**63 for up to 2**32 values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums, self.down = [], []
        for lane, part in enumerate((values, values >> U(32))):
            up, down = powers(lane, n + 1)
            sums = np.zeros(n + 1, U)
            np.cumsum(part % PRIME * up[:n] % PRIME, out=sums[1:])
            self.sums.append(sums)
            self.down.append(down)

    @staticmethod
    def _joined(lanes: list[np.ndarray]) -> np.ndarray:
        return (lanes[0] << U(31)) | lanes[1]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._joined([(sums[end] - sums[start]) % PRIME * down[start] % PRIME for sums, down in zip(self.sums, self.down, strict=True)])

    def all(self, length: int) -> np.ndarray:
        """Of every span of that length."""
        n = len(self.sums[0]) - length
        if n <= 0:
            return np.zeros(0, U)
        return self._joined([(sums[length:] - sums[:n]) % PRIME * down[:n] % PRIME for sums, down in zip(self.sums, self.down, strict=True)])


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts and where each begins (one more entry than texts)."""
    if pa.types.is_large_string(texts.type) or pa.types.is_string(texts.type):
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
        return buf, off - off[0]
    return flat(texts.cast(pa.string()))


def split_words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of each text's first word (one more entry than texts)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~SPACE[buf]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    held = off[:-1] < off[1:]
    at, last = off[:-1][held], off[1:][held] - 1
    begins[at] = inside[at]
    stops[last] = inside[last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, off)


def exact_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each piece of the bytes, equal for equal pieces alone, and the different pieces by number. Pieces are not empty and don't overlap."""
    size = ends - starts
    edges = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=edges[1:])
    turn = np.zeros(len(buf) + 1, np.int8)
    turn[starts] = 1
    turn[ends] -= 1
    letters = buf[np.cumsum(turn[:-1], dtype=np.int8).view(bool)]
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(letters))])
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each word; a batch's different words are hashed once."""
    if not len(starts):
        return np.zeros(0, U)
    ids, different = exact_ids(buf, starts, ends)
    return np.array([xxhash.xxh64_intdigest(x) for x in different.to_pylist()], U)[ids]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
