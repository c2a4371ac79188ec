"""Hashes of words and of runs of words for many texts at once, on whole byte buffers.

Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (odd numbers have inverses)."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        size = 1 << max(16, int(n).bit_length())
        both = []
        for b in (key, pow(key, -1, 1 << 64)):
            row = np.full(size, b, dtype=np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _POWERS[key] = (both[0], both[1])
    up, down = _POWERS[key]
    return up[:n], down[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _running(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, len(values) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:-1], dtype=np.uint64)]), down


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, text number) of each word, in order."""
    buffer = np.frombuffer(b"\n".join([b"", *[t or b"" for t in texts], b""]), dtype=np.uint8)
    word = ~_SPACE[buffer]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    owner = np.searchsorted(np.cumsum([len(t or b"") + 1 for t in texts]), start - 1, "right")
    total, down = _running(buffer.astype(np.uint64), _BASE)
    return _mix((total[end] - total[start]) * down[start]), owner


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of n words; the caller leaves out runs across texts."""
    total, down = _running(words, _STEP)
    count = max(0, len(words) - n + 1)
    return _mix((total[n : n + count] - total[:count]) * down[:count])
