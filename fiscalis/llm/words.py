"""Words of many texts at once, as positions and 64-bit hashes in numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix64

# Separators of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
SPACE_SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
SYMBOL_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

BASE = 0x9FB21C651E98DF25  # odd, so that its powers have inverses modulo 2**64
BLOCK = 1 << 18


@dataclass
class Tokens:
    """Words in order; row r holds the words `first[r]:first[r + 1]`."""
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class WordScanner:
    """Splits texts into words and hashes each word from prefix sums.

    The bytes are looked at in blocks that end between two words, so that
    temporary arrays stay small however long a text is.
    """

    def __init__(self, separators: bytes, lower: bool):
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[ord("A"):ord("Z") + 1] += 32
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(separators)] = False
        self.inside = self.inside[self.fold]
        self.value = mix64(np.arange(1, 257, dtype=np.uint64))[self.fold]
        self.power = self.inverse = np.zeros(0, dtype=np.uint64)
        self._grow(BLOCK + 1)

    def _grow(self, n: int) -> None:
        def powers(b: int) -> np.ndarray:
            out = np.full(n, b, dtype=np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)
        if n > len(self.power):
            self.power, self.inverse = powers(BASE), powers(pow(BASE, -1, 1 << 64))

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Tokens:
        n = len(data)
        begins = np.zeros(n + 1, dtype=bool)
        begins[offsets] = True
        parts, lo = [], 0
        while lo < n:
            hi = min(lo + BLOCK, n)
            if hi < n:
                cut = np.flatnonzero(~self.inside[data[lo + 1:hi + 1]] | begins[lo + 1:hi + 1])
                if len(cut):
                    hi = lo + 1 + int(cut[-1])
                else:
                    rest = np.flatnonzero(~self.inside[data[hi:]] | begins[hi:n])
                    hi = hi + int(rest[0]) if len(rest) else n
            parts.append(self._block(data[lo:hi], begins[lo:hi + 1], lo))
            lo = hi
        if parts:
            start, end, hashed = (np.concatenate(x) for x in zip(*parts, strict=True))
        else:
            start = end = np.zeros(0, dtype=np.int64)
            hashed = np.zeros(0, dtype=np.uint64)
        return Tokens(start, end, hashed, np.searchsorted(start, offsets))

    def _block(self, data: np.ndarray, begins: np.ndarray, at: int) -> tuple[np.ndarray, ...]:
        n = len(data)
        self._grow(n + 1)
        inside = self.inside[data]
        left, right = begins[:n].copy(), begins[1:].copy()
        left[0] = right[-1] = True
        left[1:] |= ~inside[:-1]
        right[:-1] |= ~inside[1:]
        start = np.flatnonzero(inside & left)
        end = np.flatnonzero(inside & right) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.power[:n], out=sums[1:])
        hashed = mix64((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        return start + at, end + at, hashed


def gram_hashes(tokens: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words that begin at each word, and whether they lie in one row."""
    n = len(tokens.hash)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, n)):
        out[:n - j] = out[:n - j] * np.uint64(BASE) + tokens.hash[j:]
    last = np.repeat(tokens.first[1:], np.diff(tokens.first))
    return mix64(out), np.arange(n) + k <= last


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of `width` values from each position on (leftmost on ties).

    The last `width` - 1 entries see fewer values; callers drop them.
    """
    best, at = values.copy(), np.arange(len(values))
    for j in range(1, min(width, len(values))):
        less = values[j:] < best[:-j]
        best[:-j][less] = values[j:][less]
        at[:-j][less] = np.flatnonzero(less) + j
    return at
