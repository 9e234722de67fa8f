"""Hashes of substrings and of runs of words, many at a time in numpy.

A prefix sum of byte times power, modulo 2**64, gives the hash of any substring by one difference
and one product; equal strings have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E6C63D0876A9A47
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Longest stretch hashed at once; longer texts are cut into overlapping stretches.
STRETCH = 1 << 18
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRETCH + 4096)
        _powers[:] = [
            np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]).cumprod(dtype=np.uint64)
            for b in (_BASE, _INVERSE)
        ]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums over data (bytes) that substring_hashes() needs; one more than bytes."""
    power = _tables(len(data))[0][: len(data)]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the substrings from start to end (exclusive)."""
    return mix((sums[end] - sums[start]) * _tables(len(sums))[1][start] + (end - start).astype(np.uint64))


def _run_hashes(words: list[bytes], n: int) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    spaces = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(data)]])
    return substring_hashes(prefix_sums(data), starts[: len(words) - n + 1], ends[n - 1 :])


def shingles(text: str, n: int) -> np.ndarray:
    """Distinct hashes, ascending, of all runs of n words (A-Z in lower case, words between white
    space). Fewer words than n are one run; without words there is none."""
    words = text.encode().translate(LOWER).split()
    if len(words) < n:
        return _run_hashes(words, len(words)) if words else np.empty(0, np.uint64)
    step = STRETCH // 64
    if len(words) <= step:
        return np.unique(_run_hashes(words, n))
    parts = [_run_hashes(words[i : i + step + n - 1], n) for i in range(0, len(words) - n + 1, step)]
    return np.unique(np.concatenate(parts))
