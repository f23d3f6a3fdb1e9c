"""Word splitting and 64-bit word hashing over Arrow string batches.

Texts stay UTF-8 bytes; every step is a NumPy pass over the batch's buffer, so
no Python object is made per word.  Work is cut into slices of about
``SLICE_BYTES`` so that memory does not depend on the batch size, and one text
longer than a slice is read piece by piece, cut only between words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U64 = np.uint64

# Freed buffers go back to the system: idle Python workers of earlier stages keep little.
pa.set_memory_pool(pa.system_memory_pool())

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LANES = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: Bytes that end a word when a word is ``[^\x20\x09-\x0D]+``.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that end a word when a word is ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
            up[0] = down[0] = 1
            tables = np.cumprod(up), np.cumprod(down)
        if size > 8 * SLICE_BYTES:  # one giant word: do not keep its tables
            return tables
        _powers = tables
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Words:
    """Words of rows ``lo`` to ``hi`` of a batch: hash, byte range, count by row."""

    lo: int
    hi: int
    hashes: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), self.counts)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), cuts


def _split(data: np.ndarray, breaks: np.ndarray, fresh: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    inside = ~breaks[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    if fresh is not None:
        before[fresh] = False
        after[fresh[fresh > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def _long_text(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(data):
        to, step = min(len(data), at + SLICE_BYTES), SLICE_BYTES
        while to < len(data):
            gaps = np.flatnonzero(breaks[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            step *= 2
            to = min(len(data), at + step)
        piece = data[at:to]
        starts, ends = _split(piece, breaks, None)
        parts.append((_hash(piece, starts, ends), starts + at, ends + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def slices(data: np.ndarray, cuts: np.ndarray, breaks: np.ndarray, *, lower: bool, hashed: bool = True) -> Iterator[Words]:
    """The words of all rows, in slices of whole rows; byte ranges count from the row's slice start."""
    lo, n = 0, len(cuts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + SLICE_BYTES, "right")) - 1)
        piece = data[cuts[lo] : cuts[hi]]
        if lower:
            piece = _LOWER[piece]
        if not len(piece):
            none = np.zeros(0, np.int64)
            yield Words(lo, hi, np.zeros(0, np.uint64), np.zeros(hi - lo, np.int64), none, none)
        elif hi == lo + 1 and len(piece) > SLICE_BYTES:
            hashes, starts, ends = _long_text(piece, breaks)
            yield Words(lo, hi, hashes, np.array([len(starts)]), starts, ends)
        else:
            local = cuts[lo : hi + 1] - cuts[lo]
            fresh = local[1:-1]
            starts, ends = _split(piece, breaks, fresh[fresh < len(piece)])
            counts = np.diff(np.searchsorted(starts, local))
            yield Words(lo, hi, _hash(piece, starts, ends) if hashed else np.zeros(0, np.uint64), counts, starts, ends)
        lo = hi


def grams(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a row, and the index of their first word."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    left = np.repeat(first + counts, counts) - np.arange(len(hashes))
    at = np.flatnonzero(left >= width)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out += hashes[at + k] * LANES[k]
        return mix(out + LANES[63]), at
