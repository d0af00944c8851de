"""Vectorised hashes of words and byte windows: rolling polynomials modulo 2**64."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_SLICE = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    held = _tables.get(base)
    if held is None or len(held) < n:
        size = max(n, _SLICE + 1024)
        held = np.ones(size, np.uint64)
        filled = 1
        while filled < size:
            k = min(filled, size - filled)
            held[filled:filled + k] = held[:k] * np.uint64(pow(base, filled, 2**64))
            filled += k
        _tables[base] = held
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all its bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`spans` takes the hash of any window."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(pow(_BASE, -1, 2**64), len(data)), out=sums[1:])
    return sums


def spans(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """64-bit hashes of the windows [start, end) behind ``sums``."""
    return mix((sums[end] - sums[start]) * _powers(_BASE, len(sums))[start])


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes of the class ``inside``; runs don't cross rows."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    on = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first[-1] = True
    before = np.concatenate(([False], on[:-1]))
    after = np.concatenate((on[1:], [False]))
    starts = np.flatnonzero(on & (~before | first[:-1]))
    ends = np.flatnonzero(on & (~after | first[1:])) + 1
    return starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; the sums are taken slice by slice, so memory follows the slice."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + _SLICE)))
        sums = prefix(data[low:ends[to - 1]])
        out[at:to] = spans(sums, starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
