"""64-bit hashes of any stretches of a sequence, from prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

import numpy as np

#: Odd bases of independent families.
BASES = (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25, 0xD1342543DE82EF95)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> "_Powers":
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (self.base, self.inverse))
        return self


_POWERS = [_Powers(b) for b in BASES]


class Windows:
    """Hashes of stretches of values (unsigned integers of any width); which picks the family."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.powers = _POWERS[which].to(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.powers.up[: len(values)], out=self.sums[1:])

    def of(self, begin, end) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.powers.down[begin])

    def all(self, length: int) -> np.ndarray:
        """Of every stretch of that length."""
        return mixed((self.sums[length:] - self.sums[:-length]) * self.powers.down[: len(self.sums) - length])
