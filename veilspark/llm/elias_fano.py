"""Elias-Fano sequences in numpy: rising integers in about ``2 + log2(universe / n)`` bits each, read where they lie."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QBxxxxxxxQQ")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
_POP = _BITS.sum(axis=1).astype(np.uint8)
#: The place of the k-th set bit of a byte.
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable").astype(np.uint8)
#: Values read at a time.
STEP = 1 << 15


def _pack(values: np.ndarray, bits: int) -> bytes:
    if not bits or not len(values):
        return b""
    parts = []
    for at in range(0, len(values), STEP):  # STEP is a multiple of eight, so parts end on whole bytes
        rows = np.unpackbits(values[at : at + STEP].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, 64 - bits :]
        parts.append(np.packbits(rows.ravel()).tobytes())
    return b"".join(parts)


def encode(values: np.ndarray, universe_bits: int) -> bytes:
    """Rising ``values`` (repeats allowed), each below ``2**universe_bits``; low parts have at most 56 bits."""
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    low_bits = int(min(56, max(0, universe_bits - max(1, int(n).bit_length()))))
    values = values.astype(np.uint64)
    low = _pack(values & np.uint64((1 << low_bits) - 1), low_bits)
    high = (values >> np.uint64(low_bits)).astype(np.int64)
    unary = np.zeros((int(high[-1]) + n) // 64 * 64 + 64, np.uint8)
    unary[high + np.arange(n)] = 1
    packed = np.packbits(unary).tobytes()
    return _HEAD.pack(n, low_bits, len(packed), len(low)) + packed + low + b"\0" * 8


class Sequence:
    """Reads an encoded sequence from bytes or a memory map; besides, one count for each 64 bits of its high parts is held."""

    def __init__(self, data: np.ndarray | bytes):
        data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        self.n, self.bits, n_high, n_low = _HEAD.unpack(data[: _HEAD.size].tobytes())
        self.size = _HEAD.size + n_high + n_low + 8 * bool(self.n)
        self.high = data[_HEAD.size : _HEAD.size + n_high].reshape(-1, 8)
        self.low = data[_HEAD.size + n_high : self.size]
        self.before = np.concatenate([[0], np.cumsum(_POP[self.high].sum(axis=1, dtype=np.int64))])

    def _highs(self, at: np.ndarray) -> np.ndarray:
        """The high parts of the values at the places ``at``: where the unary code's ``at``-th one stands, less ``at``."""
        word = np.searchsorted(self.before, at, side="right") - 1
        left = at - self.before[word]
        group = self.high[word]
        upto = np.cumsum(_POP[group], axis=1, dtype=np.int64)
        byte = (upto <= left[:, None]).sum(axis=1)
        row = np.arange(len(at))
        left -= np.where(byte > 0, upto[row, np.maximum(byte - 1, 0)], 0)
        return word * 64 + byte * 8 + _SELECT[group[row, byte], left] - at

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.int64) * self.bits
        byte, out = bit >> 3, np.zeros(len(at), np.uint64)
        for k in range(8):
            out = out << np.uint64(8) | self.low[byte + k].astype(np.uint64)
        return out << (bit & 7).astype(np.uint64) >> np.uint64(64 - self.bits)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at the places ``at``."""
        at, out = np.asarray(at, np.int64), np.empty(len(at), np.uint64)
        for k in range(0, len(at), STEP):
            some = at[k : k + STEP]
            out[k : k + STEP] = self._highs(some).astype(np.uint64) << np.uint64(self.bits) | self._lows(some)
        return out

    def values(self) -> np.ndarray:
        """All values in order."""
        ones = np.flatnonzero(np.unpackbits(self.high.ravel())) if self.n else np.zeros(0, np.int64)
        return (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.bits) | self._lows(np.arange(self.n))

    def find(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of each key among the places ``lo`` to ``hi`` (not included) of its own, or -1: by binary search there."""
        lo, end = np.array(lo, np.int64), np.array(hi, np.int64)
        hi = end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self.get(mid) < keys[live]
            lo[live[less]], hi[live[~less]] = mid[less] + 1, mid[~less]
            live = live[lo[live] < hi[live]]
        out = np.full(len(keys), -1, np.int64)
        there = np.flatnonzero(lo < end)
        there = there[self.get(lo[there]) == keys[there]]
        out[there] = lo[there]
        return out
