"""Words of Arrow text batches as 64-bit hashes, without one Python object per word.

A word is a run of bytes outside ``\\x20 \\x09-\\x0D``; A-Z are lower-cased first. All
functions work on a whole Arrow batch at once: its text is one byte buffer."""
from __future__ import annotations

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A random odd-valued code per byte, so that the polynomial hash has no structure of the text.
_CODE = np.random.RandomState(20240229).randint(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    b = np.uint64(base)
    while len(out) < n:
        out = np.concatenate([out, out * b])
        b = b * b
    return out[:n]


with np.errstate(over="ignore"):
    _UP = _powers(int(_BASE), _PIECE + 1)
    _DOWN = _powers(pow(int(_BASE), -1, 1 << 64), _PIECE + 1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8).copy()
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def words(raw: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, row) of every word."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    low = _LOWER[raw] if lower else raw
    gap = _SPACE[low]
    starts = ~gap
    starts[1:] &= gap[:-1]
    edge = off[1:-1]
    edge = edge[edge < len(raw)]
    starts[edge] = ~gap[edge]
    first = np.flatnonzero(starts)
    row = np.searchsorted(off, first, "right") - 1
    ends = gap.copy()
    ends[first] = True
    stop = np.flatnonzero(ends)
    at = np.searchsorted(stop, first, "right")
    end = np.append(stop, len(raw))[at]
    end = np.minimum(end, off[row + 1])
    h = np.empty(len(first), np.uint64)
    for lo in range(0, len(raw), _PIECE // 2):
        a, b = np.searchsorted(first, [lo, lo + _PIECE // 2])
        if a == b:
            continue
        f, e = first[a:b], end[a:b]
        top = int(e.max())
        if top - lo > _PIECE:  # words longer than a piece: one by one
            h[a:b] = [_long(low[x:y]) for x, y in zip(f, e)]
            continue
        sums = np.zeros(top - lo + 1, np.uint64)
        np.cumsum(_CODE[low[lo:top]] * _UP[:top - lo], out=sums[1:])
        h[a:b] = (sums[e - lo] - sums[f - lo]) * _DOWN[f - lo]
    return mix(h + (end - first).astype(np.uint64) * _BASE), first, end, row


def _long(b: np.ndarray) -> np.uint64:
    """The polynomial of one word of any length, piece by piece."""
    total, scale = 0, 1
    step = pow(int(_BASE), _PIECE, 1 << 64)
    for lo in range(0, len(b), _PIECE):
        x = b[lo:lo + _PIECE]
        total = (total + scale * int((_CODE[x] * _UP[:len(x)]).sum(dtype=np.uint64))) % (1 << 64)
        scale = scale * step % (1 << 64)
    return np.uint64(total)


def word_hash(word: str) -> int:
    """The hash that ``words`` gives to one word (for tests)."""
    h, *_ = words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]))
    return int(h[0])
