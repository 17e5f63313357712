"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on Arrow string buffers in place: a batch of documents
is one byte array plus offsets, and words, word hashes and word n-grams of all
its documents are found by a few numpy passes, without Python strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP, _SECOND_STEP = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0xA24BAED4963EE407))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODE_LOWER = _CODE[_LOWER]
_powers: list[np.ndarray] = []
#: Bytes of the longest word that is hashed by a polynomial. Modulo 2**64 a regular text of a thousand letters can be made to collide; longer words have a digest.
POLYNOMIAL = 64


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 19)
        up, down = np.full(size, _BASE, U64), np.full(size, _BASE_INV, U64)
        up[0] = down[0] = 1
        _powers[:] = [np.cumprod(up), np.cumprod(down)]
    return _powers


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes; a longer document is a run of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """The words of some documents: start and end byte of each, and for each document the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, between: np.ndarray = IS_SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        gap = between[data]
        word = ~gap
        before = edge[:-1].copy()
        before[1:] |= gap[:-1]
        after = edge[1:].copy()
        after[:-1] |= gap[1:]
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self, lower: bool, *heads: int) -> np.ndarray | list[np.ndarray]:
        """A 64-bit hash of each word's bytes, A-Z taken as a-z if ``lower``; with ``heads`` a list, the words' first so many bytes too."""
        n = len(self.data)
        up, down = _power_tables(n + 1)
        total = np.empty(n + 1, U64)
        total[0] = 0
        np.cumsum((_CODE_LOWER if lower else _CODE)[self.data] * up[:n], out=total[1:])
        out = []
        for k in (0, *heads):
            ends = np.minimum(self.ends, self.starts + k) if k else self.ends
            out.append(mix((total[ends] - total[self.starts]) * down[self.starts] + (ends - self.starts).astype(U64) * _STEP))
        for i in np.flatnonzero(self.ends - self.starts > POLYNOMIAL).tolist():
            raw = self.data[self.starts[i] : self.ends[i]]
            out[0][i] = int.from_bytes(hashlib.blake2b(_LOWER[raw] if lower else raw, digest_size=8).digest(), "little")
        return out if heads else out[0]


def grams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words, by its first word; runs over the end of a document are for the caller to leave out."""
    if len(word_hashes) < n:
        return np.zeros(0, U64)
    m = len(word_hashes) - n + 1
    out = word_hashes[:m].copy()
    for j in range(1, n):
        out *= _STEP
        out += word_hashes[j : j + m]
    return mix(out + U64(n))


def second_grams(word_hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """32 more bits of hash of the runs of ``n`` words that start at ``at``, for where 64 are too few."""
    out = np.zeros(len(at), U64)
    for j in range(n):
        out *= _SECOND_STEP
        out += word_hashes[at + j]
    return (mix(out) >> U64(32)).astype(np.uint32)


def shingles(words: Words, hashes: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each document its sorted distinct word n-grams; of fewer than n words the whole sequence; of none nothing."""
    every = grams(hashes, n)
    for a, k in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if k >= n:
            got = np.sort(every[a : a + k - n + 1])
            yield got[np.append(True, got[1:] != got[:-1])]
        elif k:
            yield grams(hashes[a : a + k], k)
        else:
            yield every[:0]


def document_shingles(column: pa.Array, n: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """``shingles`` of each text of a column, over whole texts in bounded runs."""
    data, offsets = string_buffers(column)
    for lo, hi in slices(offsets):
        part = Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield from shingles(part, part.hashes(lower), n)


def pack(values: np.ndarray) -> bytes:
    """An integer array as its byte planes, which block compression shrinks where high bytes are few."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def unpack(blob: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 values as differences of as few bytes as the largest needs."""
    steps = np.diff(values, prepend=U64(0)) if len(values) else values
    first, rest = steps[:1], steps[1:]
    width = max(1, (int(rest.max()).bit_length() + 7) // 8) if len(rest) else 1
    return bytes([width]) + first.tobytes() + rest.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width, raw = blob[0], np.frombuffer(blob, np.uint8)[1:]
    if not len(raw):
        return np.zeros(0, U64)
    rest = raw[8:].reshape(-1, width)
    steps = np.zeros((1 + len(rest), 8), np.uint8)
    steps[0], steps[1:, :width] = raw[:8], rest
    return np.cumsum(steps.view(U64).reshape(-1), dtype=U64)
