"""Content-defined seeds: the least k-gram hash of every window of a byte text.

Equal windows choose equal seeds at equal places, whatever stands around them, so texts that share a
window meet at its seed.
"""

from __future__ import annotations

import numpy as np

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]
#: Bytes that are worked on at a time.
CHUNK = 1 << 20


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-gram (k a multiple of 8) of bytes."""
    n = len(data) - k + 1
    word = data.astype(np.uint64)
    for step in (1, 2, 4):
        word = word[:-step] | (word[step:] << np.uint64(8 * step))
    h = word[:n] * _C[0]
    for j in range(8, k, 8):
        h ^= h >> np.uint64(32)
        h += word[j:j + n] * _C[j // 8 % 3]
        h *= _C[3]
    h ^= h >> np.uint64(32)
    h *= _C[1]
    h ^= h >> np.uint64(29)
    return h


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The least or greatest of each ``width`` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return best(values[:-rest], values[rest:]) if rest else values


def window_seeds(data: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the seeds of all windows of ``data`` that cross none of the document ``ends``; ties are all chosen."""
    wide = window - k + 1
    at, hashes = [], []
    for a in range(0, len(data) - window + 1, CHUNK):
        part = data[a:a + CHUNK + window - 1]
        h = gram_hashes(part, k)
        least = _sliding(h, wide, np.minimum)               # by window start
        ok = np.ones(len(least) + 1, dtype=bool)
        inside = ends[(ends > a) & (ends < a + len(part))] - a
        crossed = np.zeros(len(least) + 1, dtype=np.int32)
        np.add.at(crossed, np.clip(inside - window + 1, 0, len(least)), 1)
        np.add.at(crossed, np.clip(inside, 0, len(least)), -1)
        ok = np.cumsum(crossed)[:-1] == 0
        least = np.where(ok, least, np.uint64(0))
        pad = np.zeros(wide - 1, dtype=np.uint64)
        chosen = _sliding(np.concatenate([pad, least, pad]), wide, np.maximum) == h
        places = np.flatnonzero(chosen & (h > 0))
        at.append(places + a)
        hashes.append(h[places])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    at, first = np.unique(at, return_index=True)
    return at, hashes[first]
