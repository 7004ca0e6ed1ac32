"""Exact integer matrix products from float32 products modulo small primes."""

from __future__ import annotations

import numpy as np

#: Products of residues are summed over at most so many components before they are reduced.
SLAB = 256
#: Whole numbers up to this are exact in float32.
EXACT = 1 << 24


def _primes(most: int) -> list[int]:
    """Odd primes up to ``most``, largest first."""
    sieve = np.ones(most + 1, bool)
    sieve[:2] = False
    for i in range(2, int(most ** 0.5) + 1):
        if sieve[i]:
            sieve[i * i::i] = False
    return [int(p) for p in np.flatnonzero(sieve)[::-1] if p > 2]


class Residues:
    """A system of residues for vectors of one dimension whose inner products are at most ``bound`` from zero."""

    def __init__(self, dimension: int, bound: int):
        if bound >= 1 << 61:
            raise ValueError(f"inner products of up to {bound} do not fit 64 bits")
        self.slab = min(max(dimension, 1), SLAB)
        candidates = _primes(2 * int((EXACT / self.slab) ** 0.5) - 1)
        self.primes, product = [], 1
        while product <= 2 * bound:
            self.primes.append(candidates[len(self.primes)])
            product *= self.primes[-1]
        self.primes = self.primes or candidates[:1]

    def split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Residues of whole numbers, nearest to zero, one float32 matrix a prime."""
        found = []
        for p in self.primes:
            r = rows % p
            found.append(np.where(r > p // 2, r - p, r).astype(np.float32))
        return found

    def _product(self, a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
        total = np.zeros((len(a), len(b)), np.int64)
        for at in range(0, a.shape[1], self.slab):
            total += (a[:, at:at + self.slab] @ b[:, at:at + self.slab].T).astype(np.int64)
        return total % p

    def products(self, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """All inner products of two split matrices, as signed 64-bit numbers.

        The remainders are joined in mixed radix with digits around zero, so no number on the way is larger than the
        system's range.
        """
        value, radix = None, 1
        for p, left, right in zip(self.primes, a, b):
            digit = self._product(left, right, p)
            if value is not None:
                digit = (digit - value) % p * pow(radix, -1, p) % p
            digit[digit > p // 2] -= p
            value = digit if value is None else value + digit * radix
            radix *= p
        return value
