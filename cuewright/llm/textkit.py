"""Vectorised text primitives on Arrow string columns.

Everything here works on whole Arrow batches through numpy: the UTF-8 bytes of
many rows are cut into blocks of bounded size, words are found by byte class,
and each word gets a 64-bit hash from prefix sums, so there is no Python step
per word.  A row is never split over two blocks and never shortened.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
U64 = np.uint64


def _table(seed: int, n: int) -> np.ndarray:
    """n reproducible 64-bit values (splitmix64 counter mode)."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = _table(11, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_VALUE_LOWER = _BYTE_VALUE[_LOWER]
_powers = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]

#: Bytes of a word: all but space and 09-0D.  UTF-8 never holds these inside another character.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: All but line feed.
NOT_NEWLINE = np.ones(256, dtype=bool)
NOT_NEWLINE[0x0A] = False
#: First bytes of code points.
STARTS_CHAR = np.ones(256, dtype=bool)
STARTS_CHAR[0x80:0xC0] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i up to n; tables for texts longer than some blocks are not kept."""
    if len(_powers[0]) > n:
        return _powers[0], _powers[1]
    made = []
    for base in (_BASE, _BASE_INVERSE):
        out = np.full(1 << int(n).bit_length(), base, dtype=U64)
        out[0] = 1
        made.append(np.multiply.accumulate(out, out=out))
    if n <= 2 * BLOCK_BYTES:
        _powers[:] = made
    return made[0], made[1]


def release() -> None:
    """Give freed memory back to the system, so that idle workers are small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def each_batch(f, batches):
    """``f`` of each of a task's batches; memory goes back at the end."""
    try:
        for b in batches:
            yield f(b)
    finally:
        release()


def each_pair(f, batches):
    """The same for a function of several columns."""
    return each_batch(lambda b: f(*b), batches)


class Block:
    """Some rows' bytes: data, and offsets of each row in it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        self._sums: dict[bool, np.ndarray] = {}

    def spans(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of the byte class that stay in a row: starts, ends, and each row's first run."""
        w = is_word[self.data]
        n = len(w)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.rows + 1, np.int64)
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        inner = self.offsets[:-1][self.offsets[:-1] < n]
        first[inner] = w[inner]
        ends = self.offsets[1:]
        ends = ends[ends > 0] - 1
        last[ends] = w[ends]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        return s, e, np.searchsorted(s, self.offsets)

    def prefix(self, lower: bool) -> np.ndarray:
        if lower not in self._sums:
            n = len(self.data)
            out = np.zeros(n + 1, dtype=U64)
            table = _BYTE_VALUE_LOWER if lower else _BYTE_VALUE
            np.cumsum(table[self.data] * powers(n)[0][:n], out=out[1:])
            self._sums[lower] = out
        return self._sums[lower]

    def hashes(self, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
        """A hash of each byte span; equal spans anywhere have equal hashes."""
        p = self.prefix(lower)
        return mix((p[e] - p[s]) * powers(len(self.data))[1][s] + (e - s).astype(U64))

    def count(self, members: np.ndarray) -> np.ndarray:
        """How many bytes of the class each row has."""
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(members[self.data], out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of an Arrow string column in order, in blocks; a null is like an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        for chunk in texts.chunks:
            yield from blocks(chunk, block_bytes)
        return
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(at, at[row] + block_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), n)
        yield Block(raw[at[row] : at[stop]], at[row : stop + 1] - at[row])
        row = stop


_GRAM = _table(23, 64) | U64(1)


def grams(h: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, in each row; rows are h[first[i]:first[i+1]].

    With ``short`` a row of fewer words, but not none, has one gram, all of it.
    Returns the hashes and each row's first.
    """
    n = np.diff(first)
    m = np.maximum(n - k + 1, 0)
    short_rows = np.flatnonzero((n > 0) & (n < k)) if short else np.zeros(0, np.int64)
    m[short_rows] = 1
    out_first = np.zeros(len(first), dtype=np.int64)
    np.cumsum(m, out=out_first[1:])
    total = int(out_first[-1])
    if not total:
        return np.zeros(0, dtype=U64), out_first
    start = np.arange(total, dtype=np.int64) + np.repeat(first[:-1] - out_first[:-1], m)
    out = np.zeros(total, dtype=U64)
    padded = np.concatenate([h, np.zeros(k, dtype=U64)])
    for j in range(k):
        out += padded[start + j] * _GRAM[j % 64] + U64(j)
    for i in short_rows:
        own = h[first[i] : first[i + 1]]
        out[out_first[i]] = (own * _GRAM[: len(own)]).sum(dtype=U64) + U64(0x51ED27 + len(own))
    return mix(out), out_first


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in order, and each row's first."""
    parts, sizes = [], np.zeros(len(first), dtype=np.int64)
    for i in range(len(first) - 1):
        own = np.sort(h[first[i] : first[i + 1]])
        if len(own) > 1:
            keep = np.empty(len(own), dtype=bool)
            keep[0] = True
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            own = own[keep]
        parts.append(own)
        sizes[i + 1] = len(own)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=U64)), np.cumsum(sizes)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's long."""
    return x.view(np.int64)


def lists(values: np.ndarray, width: int) -> pa.Array:
    """Rows of ``width`` values as an Arrow list column."""
    rows = len(values) // width if width else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.array(values.ravel()))
