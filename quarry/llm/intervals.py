"""Suffix intervals of a byte text by breadth-first backward extension on its Burrows-Wheeler transform.

An interval holds the suffixes that share a prefix of some length. Extending all intervals of length l
by each character before them, as the transform gives it, yields those of length l + 1, so common
prefixes come out by increasing value, and the search stops at the least length that matters.
"""

from __future__ import annotations

import numpy as np


def suffix_order(data: np.ndarray, length: int) -> np.ndarray:
    """Suffixes sorted by at least their first ``length`` bytes (a shorter suffix first), by doubling from 7 bytes.

    Only suffixes that still share all bytes compared so far are sorted again; ties of ``length`` bytes come in any order.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, dtype=np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for i in range(7):      # seven digits of 257 fit a word
        key = key * np.uint64(257) + padded[i:i + n]
    order = np.argsort(key)
    key = key[order]
    new = np.empty(n, dtype=bool)
    new[:1] = True
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.zeros(n + 1, dtype=np.int64)          # the first place of a suffix's class, from 1; 0 for the empty suffix
    rank[order] = (np.flatnonzero(new) + 1)[np.cumsum(new) - 1]
    done = 7
    while done < length:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        suffix = order[at]
        key = rank[suffix] * (n + 1) + rank[np.minimum(suffix + done, n)]
        again = np.argsort(key)
        key, order[at] = key[again], suffix[again]
        apart = np.empty(len(at), dtype=bool)
        apart[:1] = True
        np.not_equal(key[1:], key[:-1], out=apart[1:])
        new[at] = apart
        rank[order[at]] = (at[apart] + 1)[np.cumsum(apart) - 1]
        done *= 2
    return order


def equal_prefix_starts(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Flags over ``order``: the suffix shares fewer than ``length`` first bytes with the one before it.

    Backward extension: two neighbours that begin with the same character are told apart at value l + 1 when the
    suffixes after that character, found by the inverse of the transform's last-to-first map, lie in different
    intervals of value l. All intervals of one value are extended at once.
    """
    n = len(data)
    place = np.empty(n + 1, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    place[n] = n                                    # the empty suffix is an interval of its own
    inverse = place[order + 1]
    first = data[order]
    apart = np.empty(n, dtype=bool)
    apart[:1] = True
    np.not_equal(first[1:], first[:-1], out=apart[1:])
    still = np.flatnonzero(~apart)
    mine, before = inverse[still], inverse[still - 1]
    interval = np.zeros(n + 1, dtype=np.int32)
    for _ in range(1, length):
        np.cumsum(apart, out=interval[:n])
        split = interval[mine] != interval[before]
        if not split.any():
            break
        apart[still[split]] = True
        keep = ~split
        still, mine, before = still[keep], mine[keep], before[keep]
    return apart


def least_owner(data: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each position the least owner of a position whose next ``length`` bytes are the same."""
    if not len(data):
        return owner
    order = suffix_order(data, length)
    starts = np.flatnonzero(equal_prefix_starts(data, order, length))
    least = np.minimum.reduceat(owner[order], starts)
    out = np.empty(len(data), dtype=owner.dtype)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(data))))
    return out
