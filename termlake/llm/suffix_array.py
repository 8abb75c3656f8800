"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

The text of a shard is an array of small integers that ends with a unique smallest 0. Suffixes
are classified as smaller (S) or larger (L) than their right neighbour; the leftmost S suffixes
(LMS) are sorted by inducing from their first letters, named, and, where names repeat, sorted by
the same procedure on the names; from them all suffixes are induced in two linear passes, bucket by bucket
in whole arrays. Names of more than 512 kinds have too many buckets for that and are sorted by
doubling the compared length instead. Letters are below 256.
"""

from __future__ import annotations

import numpy as np

_FEW = 512


def classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one to its right."""
    n = len(t)
    s = np.zeros(n, bool)
    s[-1] = True
    if n > 1:
        step = np.sign(t[1:].astype(np.int64) - t[:-1])
        where = np.where(step != 0, np.arange(n - 1), n)
        nxt = np.minimum.accumulate(where[::-1])[::-1]
        decided = nxt < n
        s[:-1][decided] = step[nxt[decided]] > 0
    return s


def _deal(at: np.ndarray, letters: np.ndarray, free: np.ndarray, sa: np.ndarray, down: bool) -> None:
    """Write suffixes `at` into the buckets of their letters, in order, from `free` on."""
    order = np.argsort(letters, kind="stable")
    ch = letters[order]
    new = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
    size = np.diff(np.append(new, len(ch)))
    inner = np.arange(len(ch)) - np.repeat(new, size)
    heads = ch[new]
    if down:
        sa[np.repeat(free[heads], size) - inner] = at[order]
        free[heads] -= size
    else:
        sa[np.repeat(free[heads], size) + inner] = at[order]
        free[heads] += size


def _induce_arrays(t, s, bounds, lms, k):
    n = len(t)
    t16 = t.astype(np.uint16)
    sa = np.full(n, -1, np.int64)
    tail = bounds[1:] - 1
    tail = tail.copy()
    _deal(lms[::-1], t16[lms[::-1]], tail, sa, True)
    head = bounds[:-1].copy()
    for c in range(k):
        lo, first_s = bounds[c], tail[c] + 1
        done = lo
        while True:
            upto = head[c]
            if done >= upto:
                break
            at = sa[done:upto] - 1
            done = upto
            at = at[at >= 0]
            at = at[~s[at]]
            if len(at):
                _deal(at, t16[at], head, sa, False)
        at = sa[first_s : bounds[c + 1]] - 1
        at = at[at >= 0]
        at = at[~s[at]]
        if len(at):
            _deal(at, t16[at], head, sa, False)
    # the S part is filled anew from the right
    tail = bounds[1:] - 1
    tail = tail.copy()
    for c in range(k - 1, -1, -1):
        done = bounds[c + 1] - 1
        while done > tail[c]:
            upto = tail[c]
            at = sa[upto + 1 : done + 1][::-1] - 1
            done = upto
            at = at[at >= 0]
            at = at[s[at]]
            if len(at):
                _deal(at, t16[at], tail, sa, True)
        at = sa[bounds[c] : head[c]][::-1] - 1
        at = at[at >= 0]
        at = at[s[at]]
        if len(at):
            _deal(at, t16[at], tail, sa, True)
    sa[0] = n - 1
    return sa


def _by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a text with many letters: sort by 1, 2, 4, ... letters, what is still tied only."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    ranked = names[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    k = 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who = order[at]
        second = np.where(who + k < n, rank[np.minimum(who + k, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[at] = who
        split = np.concatenate([[True], key[1:] != key[:-1]])
        new[at[split]] = True
        rank[who] = np.maximum.accumulate(np.where(split, at, 0))
        k *= 2


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t in ascending order; t ends with its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    k = int(t.max()) + 1
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    bounds = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=k))])
    if k > _FEW:
        return _by_doubling(t)
    sa = _induce_arrays(t, s, bounds, lms, k)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = sa[is_lms[sa]]
    names, count = _names(t, ranked, lms)
    if count == len(lms):
        order = np.empty(len(lms), np.int64)
        order[names] = np.arange(len(lms))
    else:
        order = suffix_array(names)
    return _induce_arrays(t, s, bounds, lms[order], k)


def _names(t, ranked, lms):
    """Names of the LMS substrings in text order (equal ones share a name), and how many there are."""
    length = np.empty(len(t) + 1, np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    size = length[ranked]
    differs = np.ones(len(ranked), bool)
    same = np.flatnonzero(size[1:] == size[:-1]) + 1
    # compare neighbours letter by letter, all pairs that are still equal at once
    a, b, left, k = ranked[same], ranked[same - 1], size[same], 0
    live = np.arange(len(same))
    while len(live):
        live = live[left[live] > k]
        if not len(live):
            break
        equal = t[a[live] + k] == t[b[live] + k]
        live, gone = live[equal], live[~equal]
        left[gone] = -1
        k += 1
    differs[same[left >= 0]] = False
    names = np.empty(len(t), np.int64)
    names[ranked] = np.cumsum(differs) - 1
    return names[lms], int(differs.sum())


def common_prefixes(t: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """lcp[i]: letters that suffixes sa[i] and sa[i - 1] share, counted to `cap`; by way of the
    permuted array (in text order), where a value is at least its left neighbour's less one."""
    n = len(t)
    t = np.asarray(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    # a comparison starts only where the pair (i, before[i]) doesn't continue its left neighbour's
    i = np.arange(n)
    carried = np.zeros(n, bool)
    carried[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (t[:-1] == t[np.maximum(before[:-1], 0)])
    head = np.flatnonzero(~carried)
    need = cap + np.diff(np.append(head, n))
    live = np.flatnonzero(before[head] >= 0)
    # eight letters at a time
    packed, padded = np.zeros(n + 8, np.uint64), np.append(t, np.zeros(16, t.dtype)).astype(np.uint64)
    for k in range(8):
        packed |= padded[k : k + n + 8] << np.uint64(8 * k)
    match, k = np.zeros(len(head), np.int64), 0
    while len(live):
        a, b = head[live] + k, before[head[live]] + k
        ok = (a < n) & (b < n) & (k < need[live])
        live, a, b = live[ok], a[ok], b[ok]
        x = packed[a] ^ packed[b]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
        match[live] = k + same
        live = live[same == 8]
        k += 8
    owner = np.repeat(np.arange(len(head)), np.diff(np.append(head, n)))
    plcp = np.where(before >= 0, np.maximum(match[owner] - (i - head[owner]), 0), 0)
    return np.minimum(plcp[sa], cap)
