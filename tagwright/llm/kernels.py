"""Vectorised byte-level text kernels shared by the Python-side operators.

Tokens are hashed with a polynomial over their bytes modulo 2**64: one running sum over a
buffer gives the hash of every token in it, whatever its length.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, b in enumerate((_BASE, _INVERSE)):
            run = np.full(size, b, np.uint64)
            run[0] = 1
            _powers[k] = np.multiply.accumulate(run)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; it doesn't depend on the position."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), at


def slices(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes together, each of one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def tokens(data: np.ndarray, offsets: np.ndarray, segment: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row between ASCII white space, A-Z lower-cased: hash, row, start and end byte.

    Rows longer than ``segment`` are worked off piece by piece, cut at white space.
    """
    out, a, end = [], int(offsets[0]), int(offsets[-1])
    while a < end:
        b = min(end, a + segment)
        while b < end:  # on to a place where no word is cut
            gap = np.flatnonzero(SPACE[data[b : b + segment]])
            row = offsets[np.searchsorted(offsets, b)]
            b = min(b + int(gap[0]) if len(gap) else min(end, b + segment), int(row))
            if b == row or len(gap):
                break
        x = LOWER[data[a:b]]
        gap, first = SPACE[x], np.zeros(b - a + 1, bool)
        first[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        first[[0, -1]] = True
        before = np.concatenate([[True], gap[:-1]])
        after = np.concatenate([gap[1:], [True]])
        starts, ends = np.flatnonzero(~gap & (before | first[:-1])), np.flatnonzero(~gap & (after | first[1:])) + 1
        out.append((span_hashes(x, starts, ends), np.searchsorted(offsets, starts + a, "right") - 1, starts + a, ends + a))
        a = b
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` successive words within each row, and their rows.

    A row of fewer words, one at least, has one shingle: all its words.
    """
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    begin = np.arange(len(words))
    keep = begin + width <= ends[rows] if len(words) else np.zeros(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < width))
    starts = np.concatenate([begin[keep], (ends - counts)[short]])
    stops = np.concatenate([begin[keep] + width, ends[short]])
    of = np.concatenate([rows[keep], short])
    order = np.argsort(of, kind="stable") if len(short) else slice(None)
    return span_hashes(words, starts[order], stops[order]), of[order]


def trim() -> None:
    """Give freed memory back to the system: a worker outlives its tasks and would hold it."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
