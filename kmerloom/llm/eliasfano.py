"""Elias-Fano encoding of sorted distinct 64-bit numbers: high bits in unary, low bits packed."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Numbers below 2**width, one behind the other, in 64-bit words (one spare word at the end)."""
    if width == 0:
        return np.zeros(1, np.uint64)
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
    word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    words = np.zeros(len(values) * width // 64 + 2, np.uint64)
    np.bitwise_or.at(words, word, values << bit)
    over = bit + np.uint64(width) > 64
    np.bitwise_or.at(words, word[over] + 1, values[over] >> (np.uint64(64) - bit[over]))
    return words


def _unpack(words: np.ndarray, width: int, index: np.ndarray) -> np.ndarray:
    if width == 0:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.uint64) * np.uint64(width)
    word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    low = words[word] >> bit
    high = np.where(bit == 0, np.uint64(0), words[word + 1] << ((np.uint64(64) - bit) & np.uint64(63)))
    return (low | high) & np.uint64((1 << width) - 1)


class EliasFano:
    """A static sorted set of ``n`` numbers below 2**universe_bits in about log2(2**universe_bits / n) + 2 bits each."""

    def __init__(self, values: np.ndarray, universe_bits: int) -> None:
        self.n = len(values)
        self.width = max(0, universe_bits - max(1, self.n).bit_length())
        high = values >> np.uint64(self.width)
        self.low = _pack(values & np.uint64((1 << self.width) - 1), self.width)
        buckets = 1 << (universe_bits - self.width)
        bits = np.zeros((self.n + buckets + 63) // 64 * 64, np.uint8)
        bits[high.astype(np.int64) + np.arange(self.n)] = 1
        bits[self.n + buckets :] = 1  # padding isn't a bucket's end
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        self._count_zeros()

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.zeros.nbytes

    def to_bytes(self) -> bytes:
        """Three numbers (members, low width, low words), the low words, the high words."""
        return np.array([self.n, self.width, len(self.low)], np.int64).tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        self = cls.__new__(cls)
        self.n, self.width, n_low = (int(x) for x in np.frombuffer(data, np.int64, 3))
        words = np.frombuffer(data, np.uint64, offset=24)
        self.low, self.high = words[:n_low], words[n_low:]
        self._count_zeros()
        return self

    def _count_zeros(self) -> None:
        zeros = 64 - np.bitwise_count(self.high).astype(np.int64)
        self.zeros = np.concatenate([[0], np.cumsum(zeros)])

    def _end(self, bucket: np.ndarray) -> np.ndarray:
        """Numbers in all buckets up to and including ``bucket``: the place of its 0 bit less the zeros before it."""
        word = np.searchsorted(self.zeros, bucket, side="right") - 1
        rest = bucket - self.zeros[word]
        bits = np.unpackbits(self.high[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seen = np.cumsum(bits == 0, axis=1)
        return word * 64 + np.argmax(seen > rest[:, None], axis=1) - bucket

    def contains(self, probes: np.ndarray, step: int = 1 << 14) -> np.ndarray:
        """For each probe whether its successor (the least member not below it) is the probe itself."""
        out = np.zeros(len(probes), bool)
        if self.n == 0:
            return out
        for k in range(0, len(probes), step):
            p = probes[k : k + step]
            bucket = (p >> np.uint64(self.width)).astype(np.int64)
            end = self._end(bucket)
            at = np.where(bucket > 0, self._end(np.maximum(bucket - 1, 0)), 0)
            want = p & np.uint64((1 << self.width) - 1)
            live = np.flatnonzero(at < end)
            while len(live):
                got = _unpack(self.low, self.width, at[live])
                out[k + live[got == want[live]]] = True
                live = live[got < want[live]]
                at[live] += 1
                live = live[at[live] < end[live]]
        return out

    def decode(self) -> np.ndarray:
        bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
        ones = np.flatnonzero(bits)[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64)
        return (high << np.uint64(self.width)) | _unpack(self.low, self.width, np.arange(self.n))


class SeenSet:
    """A growing set as a few Elias-Fano runs; a new batch is merged with the runs that it reaches in size."""

    def __init__(self, universe_bits: int) -> None:
        self.bits, self.runs = universe_bits, []

    def contains(self, probes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(probes), bool)
        for run in self.runs:
            left = np.flatnonzero(~out)
            out[left] = run.contains(probes[left])
        return out

    def add(self, values: np.ndarray) -> None:
        """``values``: sorted, distinct, none of them contained yet."""
        if not len(values):
            return
        while self.runs and self.runs[-1].n <= 2 * len(values):
            values = np.sort(np.concatenate([self.runs.pop().decode(), values]), kind="stable")
        self.runs.append(EliasFano(values, self.bits))

    def whole(self) -> EliasFano:
        """All members as one run."""
        if len(self.runs) != 1:
            values = [r.decode() for r in self.runs]
            self.runs = [EliasFano(np.sort(np.concatenate(values), kind="stable") if values else np.zeros(0, np.uint64), self.bits)]
        return self.runs[0]

    def nbytes(self) -> int:
        return sum(r.nbytes() for r in self.runs)
