"""Vectorised 64-bit hashing of many texts at once: mixers, window hashes over flat arrays, sliding minima."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers with well spread bits, and the inverses of the two bases modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSE = tuple(pow(b, -1, 1 << 64) for b in BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
        x *= U(0xD6E8FEB86659FD93)
        x ^= x >> U(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64."""
    out = np.full(max(n, 1), U(base))
    out[0] = U(1)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all windows of a flat array of symbols; one window costs one subtraction and one multiplication."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for salt, (b, i) in enumerate(zip(BASES, INVERSE)):
                values = mix(symbols.astype(np.uint64) + U(salt * 0x5851F42D4C957F2D + 1))
                s = np.zeros(n + 1, np.uint64)
                np.cumsum(values * _powers(b, n), out=s[1:])
                self.sums.append(s)
                self.back.append(_powers(i, n + 1))

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the windows [begin, end) of any lengths."""
        with np.errstate(over="ignore"):
            one, two = ((s[end] - s[begin]) * r[begin] for s, r in zip(self.sums, self.back))
            return mix(one ^ (mix(two) + U(1)))

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all windows of one length, by start."""
        m = self.n - length + 1
        if m <= 0:
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            one, two = ((s[length:] - s[:m]) * r[:m] for s, r in zip(self.sums, self.back))
            return mix(one ^ (mix(two) + U(1)))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by the first of them, in log2(width) passes."""
    if len(x) < width:
        return x[:0]
    have, m = 1, x
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[: len(m) - step], m[step:])
        have += step
    return m


def winnow(h: np.ndarray, width: int) -> np.ndarray:
    """Places such that every ``width`` neighbours of ``h`` hold at least one, chosen by content alone: those that are the least of
    some ``width`` neighbours. Fewer than ``width`` values keep their least."""
    if not len(h):
        return np.empty(0, np.int64)
    width = min(width, len(h))
    low = sliding_min(h, width)
    # place i is chosen if h[i] equals the minimum of any run of neighbours it lies in, that is if it equals the greatest of those minima
    pad = np.zeros(width - 1, np.uint64)
    top = ~sliding_min(~np.concatenate([pad, low, pad]), width)
    return np.flatnonzero(h == top)
