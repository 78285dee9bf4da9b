"""Suffix arrays of bounded pieces of text, in numpy."""

from __future__ import annotations

import numpy as np


def leading_words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number, in byte order (zeros past the end)."""
    padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    words = padded[: len(data)]
    for step in range(1, 8):
        words = (words << np.uint64(8)) | padded[step : len(data) + step]
    return words


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Positions ordered by their suffixes.

    Larsson-Sadakane: suffixes equal in their first h bytes form a group with a common rank;
    a group is refined by the ranks of the suffixes h bytes on, which doubles h. Suffixes that
    are alone in their group are settled and take no part in later rounds.
    """
    n = len(data)
    key = leading_words(data)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    key = key[order]
    fresh = np.append(True, key[1:] != key[:-1]) if n else np.empty(0, bool)
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = first
    h = 8
    open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    while len(open_):
        at = order[open_]
        group = first[open_]
        after = rank[np.minimum(at + h, n)]
        sub = np.argsort(group * (n + 1) + after + 1, kind="stable")
        at, after = at[sub], after[sub]
        order[open_] = at
        new = np.append(True, (group[1:] != group[:-1]) | (after[1:] != after[:-1]))
        leader = np.maximum.accumulate(np.where(new, open_, 0))
        first[open_] = leader
        rank[at] = leader
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int, lanes: int = 4096):
    """For each place in ``order`` but the first, the bytes shared with the suffix before it.

    Kasai: going through the text position by position, the length shared with the
    predecessor drops by at most one, so only the rest is compared. Here many stretches of
    the text are gone through side by side, 8 bytes at a time. Counts stop at ``limit``.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    words = np.append(leading_words(data), np.zeros(limit + 8, np.uint64))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    length = -(-n // lanes)
    start = np.arange(0, n, length)
    shared = np.zeros(len(start), np.int64)
    for step in range(length):
        at = start + step
        at = at[at < n]
        shared = np.maximum(shared[: len(at)] - 1, 0)
        where = place[at]
        before = order[where - 1]
        shared[where == 0] = 0
        going = np.flatnonzero(where > 0)
        while len(going):
            s = shared[going]
            apart = words[at[going] + s] ^ words[before[going] + s]
            same = apart == 0
            # leading equal bytes of words that differ
            part = np.zeros(len(going), np.int64)
            for byte in range(1, 8):
                part += apart >> np.uint64(64 - 8 * byte) == 0
            shared[going] = np.minimum(s + np.where(same, 8, part), limit)
            going = going[same & (s + 8 < limit)]
        room = n - np.maximum(at, before)
        shared = np.minimum(shared, np.where(where > 0, room, 0))
        out[where] = shared
    return out


def classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A number for each start: equal exactly for equal strings of ``length`` bytes.

    All of ``starts`` must have that many bytes.
    """
    order = suffix_array(data)
    shared = common_prefixes(data, order, length)
    number = np.empty(len(data), np.int64)
    number[order] = np.cumsum(shared < length)
    return number[starts]
