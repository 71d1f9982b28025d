"""Texts as arrays of code points, and fingerprints of all their windows in linear time."""

from __future__ import annotations

import unicodedata

import numpy as np

MASK = 0xFFFFFFFFFFFFFFFF


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixing bijection (splitmix64's finalizer after adding the seed)."""
    x = x + np.uint64(seed & MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one behind the other, and where each text starts (with the end as the last entry)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return code_points("".join(texts)), starts


class Windows:
    """Fingerprints of all windows of ``width`` code points: prefix sums of a polynomial modulo 2**64.

    Code points are mixed into 64 random-looking bits first; a fingerprint's chance to be that of another
    window is about 2**-64. Different seeds give independent fingerprints.
    """

    def __init__(self, width: int, seed: int = 1) -> None:
        self.width, self.seed = width, seed
        base = (int(mix(np.array([seed], np.uint64), 77)[0]) | 5) & MASK
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes)
        if n < self.width:
            return np.zeros(0, np.uint64)
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(n + n // 4, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64), self.seed) * self.up[:n], dtype=np.uint64, out=sums[1:])
        got = (sums[self.width :] - sums[: n - self.width + 1]) * self.down[: n - self.width + 1]
        return got ^ (got >> np.uint64(29))


def runs_below(bad: np.ndarray, width: int) -> np.ndarray:
    """For each start whether the window of ``width`` places from it holds no bad place."""
    sums = np.zeros(len(bad) + 1, np.int64)
    np.cumsum(bad, out=sums[1:])
    return sums[width:] == sums[: len(bad) - width + 1] if len(bad) >= width else np.zeros(0, bool)


def letters_and_digits() -> bytes:
    """A bit for every code point: whether it is a Unicode letter or number (packed, to be shipped to executors)."""
    return np.packbits([unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)]).tobytes()


def normalized(text: str, kept: np.ndarray) -> np.ndarray:
    """Code points of the lower-cased text that ``kept`` (a boolean per code point) holds."""
    codes = code_points(text.lower())
    return codes[kept[codes]]
