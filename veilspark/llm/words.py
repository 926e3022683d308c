"""Words of whole texts as numpy arrays, many documents at a time.

A word is ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. All of a chunk's UTF-8 bytes are hashed in one pass: a word's
hash is the sum of ``T[byte] * B**place`` over its bytes modulo 2**64, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_RNG = np.random.Generator(np.random.PCG64(20240611))
_TABLE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_TABLE[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    steps = np.full(n, _BASE, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text each; a longer single text is a range of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts end to end, and where each begins (one more entry than texts). Null is empty."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, in order, and for each text where its words begin (one more entry than texts)."""
    data, offsets = raw(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    begin, size = np.flatnonzero(begin), np.flatnonzero(end) + 1
    size -= begin
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.cumsum(size) - size
    place = np.arange(first[-1] + size[-1]) - np.repeat(first, size)
    value = _TABLE[data[solid]] * _power(int(size.max()))[place]
    return mix(np.add.reduceat(value, first)), np.searchsorted(begin, offsets)
