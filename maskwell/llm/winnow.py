"""Rolling hashes and the choice of one anchor in every window of a text, in numpy."""

from __future__ import annotations

import numpy as np

MULT = 0x9E3779B97F4A7C15
INVERSE = pow(MULT, -1, 1 << 64)
POSITION_BITS = 24
#: Units handled at once, so that positions fit their bits.
SEGMENT = 1 << 22


def _powers(base: int, n: int) -> np.ndarray:
    store = _powers.__dict__.setdefault("store", {})
    if base not in store or len(store[base]) < n:
        store[base] = np.multiply.accumulate(np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64))
    return store[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def byte_values() -> np.ndarray:
    """A fixed 64-bit value for each byte."""
    return mixed((np.arange(1, 257, dtype=np.uint64)) * np.uint64(0xA0761D6478BD642F))


def sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`ranges` takes the hash of any stretch."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(INVERSE, len(x)), out=out[1:])
    return out


def ranges(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the stretches ``[start, end)``, the same wherever a stretch lies."""
    return mixed((prefix[end] - prefix[start]) * _powers(MULT, len(prefix))[start])


def rolling(x: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` units in a row."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    p = sums(x)
    return mixed((p[k:] - p[:-k]) * _powers(MULT, len(p) - k))


def anchors(h: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every ``w`` hashes in a row the place of the least (leftmost) one: ``(place, first, last)``.

    ``first`` and ``last`` are the starts of the consecutive windows that share a place. The choice depends on the
    hashes inside the window alone, so equal windows choose alike.
    """
    n = len(h) - w + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    packed = (h & ~np.uint64((1 << POSITION_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    rows = -(-len(packed) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(packed)] = packed
    grid = grid.reshape(rows, w)
    head = np.minimum.accumulate(grid, axis=1).reshape(-1)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    place = (np.minimum(tail[:n], head[w - 1 : w - 1 + n]) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)
    turn = np.flatnonzero(place[1:] != place[:-1])
    first = np.concatenate(([0], turn + 1))
    return place[first], first, np.concatenate((turn, [n - 1]))


def segments(n: int, overlap: int):
    """``(start, end)`` stretches that cover all windows of ``overlap + 1`` units."""
    at = 0
    while True:
        yield at, min(n, at + SEGMENT)
        if at + SEGMENT >= n:
            return
        at += SEGMENT - overlap
