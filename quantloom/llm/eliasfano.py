"""Elias-Fano form of a non-decreasing sequence, with constant-time access through sampled selects."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBI")  # values, universe, low bits, ones between samples
_SAMPLE = 256


class EliasFano:
    """``values`` (non-decreasing, from 0): about 2 + log2(universe / n) bits each.

    The low bits stand in one packed array; the high parts are written in unary, so the i-th one of the upper bits
    stands at ``high(i) + i``. Every 256th one's place is kept, and a select counts on from there.
    """

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.upper, self.samples = low, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(((universe >> low_bits) + n + 64) // 64 * 64, np.uint8)
        bits[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little"), ones[::_SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        word = int.from_bytes(self.low[at >> 3:(at + self.low_bits + 7) >> 3].tobytes(), "little")
        return word >> (at & 7) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Place of the i-th one of the upper bits."""
        at, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = at >> 3
        head = int(self.upper[byte]) >> (at & 7) << (at & 7)
        while True:
            here = head.bit_count()
            if left < here:
                for _ in range(left):
                    head &= head - 1
                return byte * 8 + (head & -head).bit_length() - 1
            left -= here
            byte += 1
            head = int(self.upper[byte])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self.select(i) - i) << self.low_bits | self._low(i)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.upper, bitorder="little")) - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return (ones.astype(np.int64) << self.low_bits) | low

    def tobytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.universe, self.low_bits, len(self.samples))
        sizes = struct.pack("<QQ", len(self.low), len(self.upper))
        return head + sizes + self.low.tobytes() + self.upper.tobytes() + self.samples.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> EliasFano:
        n, universe, low_bits, samples = _HEAD.unpack_from(raw)
        n_low, n_upper = struct.unpack_from("<QQ", raw, _HEAD.size)
        at = _HEAD.size + 16
        low = np.frombuffer(raw, np.uint8, n_low, at)
        upper = np.frombuffer(raw, np.uint8, n_upper, at + n_low)
        return cls(n, universe, low_bits, low, upper, np.frombuffer(raw, "<u4", samples, at + n_low + n_upper))
