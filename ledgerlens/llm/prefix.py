"""Prefix polynomial hashes: modular prefix arrays that give the hash of any span at once."""

from __future__ import annotations

import numpy as np

# Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
_powers: dict[int, np.ndarray] = {}


def mod(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p; division by a constant is vectorised, the remainder operator is not."""
    return x - (x // p) * p


def _powers_of(base: int, p: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo p, kept in the process and doubled as needed."""
    have = _powers.get(base, np.ones(1, np.int64))
    while len(have) < n:
        have = np.concatenate([have, mod(have * pow(base, len(have), p), p)])
    _powers[base] = have
    return have[:n]


class PrefixHash:
    """Hashes of the spans of a sequence of whole numbers below 2^31.

    hash(span) = sum of symbol * base^place, the place counted from the span's start, for two primes; the
    prefix arrays hold it from the sequence's start, and the inverse power moves a span to place 0.
    """

    def __init__(self, symbols: np.ndarray):
        x = symbols.astype(np.int64) + 1
        self.n = len(x)
        self.prefix, self.inverse = [], []
        for p, base in zip(PRIMES, BASES, strict=True):
            sums = np.zeros(self.n + 1, np.int64)
            np.cumsum(mod(x * _powers_of(base, p, self.n), p), out=sums[1:])
            self.prefix.append(mod(sums, p))
            self.inverse.append(_powers_of(pow(base, -1, p), p, self.n + 1))

    def spans(self, start, stop) -> np.ndarray:
        """The 62-bit hashes of the spans [start, stop), for arrays or single places."""
        start, stop = np.asarray(start), np.asarray(stop)
        out = None
        for p, prefix, inverse in zip(PRIMES, self.prefix, self.inverse, strict=True):
            h = prefix[stop] - prefix[start]
            h = mod(np.where(h < 0, h + p, h) * inverse[start], p)
            out = h if out is None else (out << 31) | h
        return out.astype(np.uint64)

    def windows(self, size: int) -> np.ndarray:
        """The hashes of all spans of one size, in order; empty if the sequence is shorter."""
        n, out = self.n - size + 1, None
        if n <= 0:
            return np.empty(0, np.uint64)
        for p, prefix, inverse in zip(PRIMES, self.prefix, self.inverse, strict=True):
            h = mod((prefix[size:] - prefix[:n] + p) * inverse[:n], p)
            out = h if out is None else (out << 31) | h
        return out.astype(np.uint64)

    def same(self, a: int, other: PrefixHash, b: int, size: int) -> bool:
        """Whether the spans of a size at a here and at b in the other are equal."""
        return self.spans(a, a + size) == other.spans(b, b + size)

    def extension(self, a: int, other: PrefixHash, b: int) -> int:
        """Length of the longest common extension from a here and b in the other, by binary search."""
        low, high = 0, min(self.n - a, other.n - b)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(a, other, b, middle):
                low = middle
            else:
                high = middle - 1
        return low


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes spread evenly over 64 bits, so that their order is random."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
