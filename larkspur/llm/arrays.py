"""Texts as arrays: words, windows and their hashes for a whole portion of documents at a time.

Hashes are polynomials over the bytes modulo 2**64, taken from running sums and mixed
afterwards, so any stretch of a portion is hashed in constant time.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd, so they have inverses


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    x = np.full(n, b, U)
                    x[0] = 1
                    setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


_BYTES, _WORDS = _Powers(_P), _Powers(_Q)


def release() -> None:
    """Gives memory that is free back to the system; a worker outlives the step that needed most."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Prefix:
    """Hashes of stretches [a, b) of a sequence of numbers."""

    def __init__(self, values: np.ndarray, powers: _Powers = _BYTES):
        self.powers, n = powers, len(values)
        up, _ = powers.get(n + 1)
        self.sums = np.zeros(n + 1, U)
        with np.errstate(over="ignore"):
            np.cumsum((values.astype(U) + U(1)) * up[:n], out=self.sums[1:])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, down = self.powers.get(len(self.sums))
        with np.errstate(over="ignore"):
            return mix((self.sums[b] - self.sums[a]) * down[a] + (b - a).astype(U) * U(_Q))


def word_prefix(values: np.ndarray) -> Prefix:
    return Prefix(values, _WORDS)


def portions(column: pa.Array, most_bytes: int = 1 << 20):
    """(first row, bytes, offsets) over a string column, nulls as empty; a longer text is alone. Offsets start at 0."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross offsets: starts, ends, and offsets into them by document."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < n]] = False
    after[cuts[cuts > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space (space and bytes 9 to 13), as spans()."""
    return spans(~_BLANK[data], offsets)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours; len(x) - w + 1 values."""
    if len(x) < w:
        return x[:0]
    m, step = x, 1
    while 2 * step <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    rest = w - step
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def by_document(offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k consecutive items of one document start, and the document of each."""
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][doc]
    return at, doc
