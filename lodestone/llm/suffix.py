"""Suffix arrays by induced sorting, a bucket at a time in numpy.

Suffixes are classified as larger or smaller than their right neighbour; the leftmost smaller ones
are sorted by their substrings (one induction, then names; names that repeat are a shorter string,
sorted by the same order of its suffixes); a last induction places every suffix in linear time.
The string of names, which is the recursion's next level, is ordered by doubling ranks among those
names that are still tied. Common prefixes of neighbours in the order are kept in text order.
"""

from __future__ import annotations

import numpy as np

from lodestone.llm.hashing import span_hashes


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour; the end of the text is smaller than all."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return step[following] > 0


def _deal(items: np.ndarray, keys: np.ndarray, to: list[list[np.ndarray]]) -> None:
    """Append ``items`` to the lists of their keys, in order."""
    o = np.argsort(keys, kind="stable")
    items, keys = items[o], keys[o]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    for k, part in zip(keys[cut].tolist(), np.split(items, cut[1:]), strict=True):
        to[k].append(part)


def induce(t: np.ndarray, smaller: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that follows from ``seeds``, the leftmost smaller suffixes in order."""
    n = len(t)
    left: list[list[np.ndarray]] = [[] for _ in range(256)]
    seeded: list[list[np.ndarray]] = [[] for _ in range(256)]
    if len(seeds):
        _deal(seeds, t[seeds], seeded)
    left[t[n - 1]].append(np.array([n - 1]))
    larger_lists: list[np.ndarray] = []
    none = np.zeros(0, np.int64)
    for c in range(256):
        done, now = [], np.concatenate(left[c]) if left[c] else none
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[~smaller[before]]
            keys = t[before]
            same = keys == c
            if not same.all():
                _deal(before[~same], keys[~same], left)
            now = before[same]
        larger_lists.append(np.concatenate(done) if done else none)
        for part in seeded[c]:
            before = part[part > 0] - 1
            if len(before):
                _deal(before, t[before], left)
    right: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []
    for c in range(255, -1, -1):
        done, now = [], np.concatenate(right[c]) if right[c] else none
        while len(now):
            done.append(now)
            before = now[now > 0] - 1
            before = before[smaller[before]]
            keys = t[before]
            same = keys == c
            if not same.all():
                _deal(before[~same], keys[~same], right)
            now = before[same]
        if done:
            out.append(np.concatenate(done))
        back = larger_lists[c][::-1]
        before = back[back > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _deal(before, t[before], right)
        if len(back):
            out.append(back)
    return np.concatenate(out)[::-1] if out else none


def order_names(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names, by doubling; only names that are still tied are sorted again."""
    n, k = len(names), 1
    o = np.argsort(names, kind="stable")
    key = names[o].astype(np.int64)
    at = np.arange(n)  # places in the order whose group has several members
    rank = np.empty(n, np.int64)
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        first = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[o[at]] = first
        tied = ~(new & np.r_[new[1:], True])
        at = at[tied]
        if not len(at):
            return o
        i = o[at]
        following = np.zeros(len(i), np.int64)
        inside = i + k < n
        following[inside] = rank[i[inside] + k] + 1
        key = (rank[i] << 32) | following
        s = np.argsort(key, kind="stable")
        o[at], key = i[s], key[s]
        k *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``t`` (uint8) in ascending order."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    smaller = classify(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        first = induce(t, smaller, lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        by_substring = first[is_lms[first]]
        place = np.searchsorted(lms, by_substring)
        end = np.minimum(np.append(lms[1:], n - 1) + 1, n)
        prints = span_hashes(t, lms, end)[place]
        size = (end - lms)[place]
        # the last substring runs to the end of the text and equals no other
        new = np.r_[True, (prints[1:] != prints[:-1]) | (size[1:] != size[:-1]) | (place[1:] == len(lms) - 1) | (place[:-1] == len(lms) - 1)]
        names = np.empty(len(lms), np.int64)
        names[place] = np.cumsum(new) - 1
        lms = by_substring if new.all() else lms[order_names(names)]
    return induce(t, smaller, lms)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """For each place of the text the prefix (at most ``cap`` bytes) that its suffix shares with the one before it in the order.

    In text order a place's value is at least its left neighbour's less one: places are filled at
    halving strides, each starting from what the nearest filled place to its left leaves.
    """
    n = len(t)
    padded = np.r_[t, np.zeros(cap + 16, np.uint8)]
    word = np.lib.stride_tricks.as_strided(padded, (n + cap + 8, 8), (1, 1)).copy().view("<u8").ravel()
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int64)

    def fill(i: np.ndarray, known: np.ndarray) -> None:
        on = before[i] >= 0
        i, length = i[on], known[on]
        j = before[i]
        most = np.minimum(cap, n - np.maximum(i, j))  # the shorter suffix ends there
        at = np.arange(len(i))
        while len(at):
            diff = word[i[at] + length[at]] ^ word[j[at] + length[at]]
            low = diff & (~diff + np.uint64(1))
            step = np.where(diff == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
            length[at] += step
            at = at[(diff == 0) & (length[at] < most[at])]
        shared[i] = np.minimum(length, most)

    stride = 1 << max(1, cap.bit_length())
    i = np.arange(0, n, stride)
    fill(i, np.zeros(len(i), np.int64))
    while stride > 1:
        half = stride // 2
        i = np.arange(half, n, stride)
        fill(i, np.maximum(shared[i - half] - half, 0))
        stride = half
    return shared
