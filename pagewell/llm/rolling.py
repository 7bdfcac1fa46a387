"""Rabin-Karp hashes of all windows of a sequence, with numpy, and their anchors."""

from __future__ import annotations

import numpy as np

# Two odd multipliers of the polynomials modulo 2**64, two constants of the final mix.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0x7FB5D329728EA185)
_BLOCK = 1 << 17

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, as far as a block with its overlap needs them."""
    if base not in _POWERS:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(2 * _BLOCK, b, dtype=np.uint64)
            table[0] = 1
            both.append(np.cumprod(table))
        _POWERS[base] = tuple(both)
    return _POWERS[base]


def window_hashes(values: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """Hash of every ``width`` consecutive values (uint64, themselves hashes), one per start.

    The value of a window is its polynomial in ``base`` modulo 2**64, found from prefix sums and then
    mixed, so it does not depend on where the window starts. ``width`` is at most the block size.
    """
    up, down = _powers(base)
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.empty(count, dtype=np.uint64)
    for at in range(0, count, _BLOCK):
        n = min(_BLOCK, count - at)
        part = values[at : at + n + width - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        h = (sums[width:] - sums[:-width]) * down[:n]
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
        out[at : at + n] = h
    return out


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    if span < width:
        values = np.minimum(values[: len(values) - (width - span)], values[width - span :])
    return values


def window_anchors(values: np.ndarray, width: int, part: int) -> np.ndarray:
    """Anchor of every window of ``width`` values: the least hash of ``part`` values inside it.

    Equal windows have equal anchors, and neighbours mostly share theirs: an anchor that no other
    text has proves all its windows unique, at a small share of the windows' number.
    """
    if len(values) < width:
        return np.empty(0, dtype=np.uint64)
    return sliding_minima(window_hashes(values, part), width - part + 1)


def merged_runs(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ``[begin, end)`` runs covered by windows of ``width`` at the given starts."""
    starts = np.unique(starts)
    if not len(starts):
        return starts, starts
    new = np.r_[True, starts[1:] > starts[:-1] + width]
    last = np.r_[new[1:], True]
    return starts[new], starts[last] + width


def uncovered(n: int, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """What the runs leave of ``[0, n)``."""
    edges = [0, *np.stack([begin, end], axis=1).ravel().tolist(), n]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
