"""Vectorised byte-level tokenising shared by the training-data operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, so a
batch of documents is tokenised and hashed by a few dozen numpy calls instead of
a Python loop over words.  White space is exactly the six ASCII characters of
the contract's word pattern; they never occur inside a multi-byte sequence, so
splitting bytes equals splitting code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the SplitMix64 constants)."""
    x = (x ^ (x >> _S30)) * _M2
    x = (x ^ (x >> _S27)) * _M3
    return x ^ (x >> _S31)


@dataclass
class Batch:
    """Texts back to back: ``data`` has eight bytes of padding, text i is data[offsets[i]:offsets[i+1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def size(self) -> int:
        return int(self.offsets[-1])


@dataclass
class Words:
    """Byte ranges of all words of a batch; words of text i are those from first[i] to first[i+1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def texts(column: pa.ChunkedArray | pa.Array) -> Batch:
    """The column's bytes without copying per row; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return Batch(np.zeros(8, np.uint8), np.zeros(1, np.int64))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    if raw is not None:
        data[:-8] = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]]
    return Batch(data, (offsets - offsets[0]).astype(np.int64))


def slices(column: pa.ChunkedArray | pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, a longer text alone: bounds the working arrays."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, to
        at = to


def words(batch: Batch) -> Words:
    gap = SPACE[batch.data[: batch.size]]
    inside = ~gap
    edge = np.zeros(batch.size + 1, bool)  # a text's border ends a word
    edge[batch.offsets] = True
    before = np.empty(batch.size, bool)
    if batch.size:
        before[0] = True
        before[1:] = gap[:-1]
        start = np.flatnonzero(inside & (before | edge[:-1]))
        after = np.ones(batch.size, bool)
        after[:-1] = gap[1:]
        end = np.flatnonzero(inside & (after | edge[1:])) + 1
    else:
        start = end = np.zeros(0, np.int64)
    return Words(start, end, np.searchsorted(start, batch.offsets))


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes at a time; data must have eight bytes of padding."""
    wide = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    left = end - start
    h = mix(left.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64))
    todo, at = np.arange(len(start)), start
    while len(todo):
        n = np.minimum(left[todo], 8)
        h[todo] = mix((h[todo] * _M1) ^ (wide[at] & _MASK[n]))
        more = left[todo] > 8
        todo, at = todo[more], at[more] + 8
        left[todo] -= 8
    return h


def window_hashes(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word, hash) of every run of ``width`` words inside one text.

    The sequence hash is a polynomial in mixed word hashes modulo 2**64, finalised, so order counts.
    """
    n = len(h)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        acc = acc * _M2 + h[j : n - width + 1 + j]
    ok = np.ones(n - width + 1, bool)
    cut = first[1:-1]
    for j in range(1, width):  # a window must not hold a later text's first word
        at = cut - j
        ok[at[(at >= 0) & (at < len(ok))]] = False
    # texts with no words share a border; the loop above covers them as well
    at = np.flatnonzero(ok)
    return at, mix(acc[at])
