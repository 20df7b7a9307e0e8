"""Rolling fingerprints of byte strings in numpy: polynomial sums modulo 2^64 over a random byte table, then mixed."""

from __future__ import annotations

import numpy as np


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Fingerprints of any substring of a byte array, from prefix sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(0, 2**61)) * 8 + 5  # odd, so it has an inverse
        self.base, self.inverse = np.uint64(base % 2**64), np.uint64(pow(base, -1, 2**64))
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, min(2 * len(self.powers), 1 << 20), 1 << 14)
            for name, step in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, step, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def at(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None, length: int = 0) -> np.ndarray:
        """Fingerprints of data[start:end], or of `length` bytes from each start."""
        stop = starts + length if ends is None else ends
        return mix((prefix[stop] - prefix[starts]) * self.inverses[starts])
