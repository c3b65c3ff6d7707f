"""Words of a byte buffer as numbers, and the seeds of runs of words."""

from __future__ import annotations

import numpy as np
import xxhash

from quarry.llm.seeds import _sliding

_SPACE = bytes(i in (9, 10, 11, 12, 13, 32) for i in range(256))
_ODD, _MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: The first bytes of eight, by how many.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: Longer words are hashed one by one.
LONG_WORD = 48
#: Words that are hashed at a time.
AT_ONCE = 1 << 15


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, first word of each document), words ``[^\\x20\\x09-\\x0D]+``; no word crosses a document's end."""
    solid = ~np.frombuffer(raw.translate(_SPACE), bool)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    at = starts[(starts < ends)]
    begins[at] = solid[at]
    finishes = solid.copy()
    finishes[:-1] &= ~solid[1:]
    finishes[at[at > 0] - 1] = solid[at[at > 0] - 1]
    low, high = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    size = high - low
    eight = np.ndarray(len(raw) + 1, "<u8", raw.lower() + bytes(8), strides=(1,))       # the eight bytes from each place on; bytes.lower() is A-Z only
    h = size.astype(np.uint64)
    for at in range(0, len(h), AT_ONCE):        # so few that they stay in the cache
        part, lead, left = h[at:at + AT_ONCE], low[at:at + AT_ONCE], size[at:at + AT_ONCE]
        part *= _ODD
        live = slice(None)
        for done in range(0, LONG_WORD, 8):
            x = eight[lead[live] + done]
            x &= _FIRST[np.minimum(left[live] - done, 8)]
            x ^= part[live]
            x *= _ODD
            x ^= x >> np.uint64(32)
            x *= _MORE
            x ^= x >> np.uint64(29)
            part[live] = x
            live = np.flatnonzero(left > done + 8)
            if not len(live):
                break
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(raw[low[i]:high[i]].lower())
    return h, np.searchsorted(low, starts)


def run_seeds(words: np.ndarray, first: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the least k-run of words among each ``width`` neighbours in a document, or all of a shorter one; ties are all chosen."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h ^= words[j:j + n]
        h *= _ODD
        h ^= h >> np.uint64(31)
    last = np.append(first[1:], len(words))
    crossed = np.zeros(n + 1, dtype=np.int32)       # runs that lie in no document whole
    np.add.at(crossed, np.clip(last - k + 1, 0, n), 1)
    np.add.at(crossed, np.clip(last, 0, n), -1)
    whole = np.cumsum(crossed)[:-1] == 0
    if width == 1:
        at = np.flatnonzero(whole)
        return at, h[at]
    high = np.iinfo(np.uint64).max
    h = np.where(whole, np.minimum(h, high - np.uint64(1)), high)
    # a window of runs may stretch over a document's end: runs there are greatest, and those of the next document get a gap
    doc = np.searchsorted(first, np.arange(n), side="right")
    gap = np.concatenate([[0], np.cumsum((np.diff(doc) > 0) * width)])
    spread = np.full(int(gap[-1]) + n + 2 * width, high, dtype=np.uint64)
    place = np.arange(n) + gap + width
    spread[place] = h
    least = _sliding(spread, width, np.minimum)
    least = np.where(least == high, np.uint64(0), least)
    pad = np.zeros(width - 1, dtype=np.uint64)
    chosen = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)[place] == h
    at = np.flatnonzero(chosen & whole)
    return at, h[at]


def longer_runs(full: np.ndarray, held: np.ndarray, run: int, lengths: tuple[int, ...]):
    """(length, place, hash) of the runs of each length, at most twice or thrice the one before, of which every part of ``run`` words is held.

    ``full`` has the hash of the run at each place, ``held`` whether it is held.
    """
    total = np.concatenate([[0], np.cumsum(held)])
    h, size = full, run
    for k in lengths:
        n = len(full) - k + 1
        if n <= 0:
            return
        longer = np.full(n, k, dtype=np.uint64)
        for at in (*range(0, k - size, size), k - size):
            longer ^= h[at:at + n]
            longer *= _ODD
            longer ^= longer >> np.uint64(31)
        h, size = longer, k
        place = np.flatnonzero(total[k - run + 1:][:n] - total[:n] == k - run + 1)
        yield k, place, h[place]
