"""Hashes of the words of many texts at once, without a Python object for each word.

A word's hash is a polynomial of its bytes modulo 2^64, taken as the difference of two prefix sums over the joined texts and
divided by the power at which the word begins. Words are what is between blanks; A-Z count in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
#: Bytes of texts hashed at once; a longer text is cut between words.
PIECE = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (the finalizer of splitmix64)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BASE = 0xD1342543DE82EF95
LETTER = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[U(1)], np.full(n - 1, base, U)]))


def hashes_of(data: bytes, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` and where they begin."""
    b = np.frombuffer(data, np.uint8)
    blank = np.concatenate([[True], BLANK[b], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(b) + 1, U)
    np.cumsum(LETTER[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts


class WordHasher:
    def __init__(self):
        self.up = self.down = np.zeros(0, U)

    def some(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > len(self.up):
            n = max(PIECE + 1, 2 * len(data))
            self.up, self.down = powers(BASE, n), powers(pow(BASE, -1, 1 << 64), n)
        return hashes_of(data, self.up, self.down)

    def long(self, data: bytes) -> np.ndarray:
        """Hashes of the words of a text of any length, piece by piece."""
        found, begin = [], 0
        while begin < len(data):
            end = begin + PIECE
            while end < len(data) and not BLANK[data[end]]:  # a word is never cut
                end += 1
            found.append(self.some(data[begin:end])[0])
            begin = end
        return np.concatenate(found) if found else np.zeros(0, U)

    def words(self, texts: Sequence[str | None]) -> Iterator[np.ndarray]:
        """The hashes of the words of each text, in order; null and empty texts have none."""
        k = 0
        while k < len(texts):
            first, size, joined = k, 0, []
            while k < len(texts) and size < PIECE:
                data = texts[k].encode().lower() if texts[k] else b""
                if len(data) > PIECE:
                    if k == first:
                        yield self.long(data)
                        first = k = k + 1
                        continue
                    break
                joined.append(data)
                size, k = size + len(data) + 1, k + 1
            if joined:
                h, starts = self.some(b"\n".join(joined))
                ends = np.cumsum([len(d) + 1 for d in joined])
                cuts = np.searchsorted(starts, ends)
                yield from np.split(h, cuts[:-1])
