"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are handled in pieces of about half a megabyte, never cut
inside a text, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

PIECE_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U64 = np.uint64


@cache
def _allocator():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library, which keeps what it likes
        return lambda _: 0


def trim() -> None:
    """Give freed memory back to the system: a worker that waits for its next task then holds little."""
    pa.default_memory_pool().release_unused()
    _allocator()(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Words of more bytes are hashed one by one; the rest together, eight bytes at a time.
SHORT = 64


class Hasher:
    """64-bit hashes of byte strings and of sequences of hashes.

    Every step goes through the finaliser, so no algebra of the steps makes strings collide, as it does for
    polynomials modulo 2^64. Two seeds give two independent hashes.
    """

    def __init__(self, seed: int):
        self.seed = (seed * 0xD1B54A32D192ED03 + 0x2545F4914F6CDD1D) % (1 << 64)
        self.turn = U64((0x9E3779B97F4A7C15 * (2 * seed + 3)) % (1 << 64) | 1)

    def of_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each slice of ``data``."""
        sizes = (ends - starts).astype(np.int64)
        out = mix(sizes.astype(np.uint64) * self.turn + U64(self.seed))
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
        short = np.flatnonzero((sizes > 0) & (sizes <= SHORT))
        at = 0
        while len(short):
            block = eights[starts[short] + at].view("<u8").ravel()
            left = sizes[short] - at
            block = block & _MASKS[np.minimum(left, 8)]
            out[short] = mix((out[short] ^ block) * self.turn)
            at += 8
            short = short[left > 8]
        long = np.flatnonzero(sizes > SHORT)
        if len(long):
            raw = memoryview(np.ascontiguousarray(data))
            out[long] = [xxhash.xxh3_64_intdigest(raw[a:b], self.seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        return out

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """A hash of each two hashes, in order."""
        return mix(first * self.turn + second)

    def runs(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """A hash of each ``size`` consecutive hashes, by doubling; one for each place at which a run fits."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out, done, power, length = None, 0, hashes, 1
        while True:
            if size & length:
                part = power[done : done + n]
                out, done = (part if out is None else self.pairs(out, part)), done + length
            if done == size:
                return mix(out + U64(size * (self.seed | 1) % (1 << 64)))
            power, length = self.pairs(power[:-length], power[length:]), 2 * length


_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


@dataclass
class Piece:
    """Some consecutive texts of a batch. ``words[i]:words[i + 1]`` are text i's words."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray

    def __len__(self) -> int:
        return len(self.words) - 1


def text_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:  # else this would only be a copy
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def pieces(texts: pa.Array, lower: bool = False, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """The texts' words, piece by piece."""
    data, bounds = text_arrays(texts)
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1
        last = min(max(last, first + 1), n)
        part = data[bounds[first] : bounds[last]]
        yield _words(first, _LOWER[part] if lower else part, bounds[first : last + 1] - bounds[first])
        first = last
    trim()


def _words(first: int, data: np.ndarray, bounds: np.ndarray) -> Piece:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Piece(first, data, none, none, np.zeros(len(bounds), np.int64))
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Piece(first, data, starts, ends, np.searchsorted(starts, bounds))
