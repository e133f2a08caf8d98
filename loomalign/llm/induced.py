"""Suffix arrays by induced sorting, and permuted common prefixes, on NumPy arrays.

The text is bytes.  Suffixes are classified as larger (L) or smaller (S) than
their right neighbour; the substrings between leftmost-smaller (LMS) positions
are sorted by induction and named, the string of names is sorted recursively,
and two linear scans induce the whole array from the sorted LMS suffixes.

A scan does not go position by position: it takes the part of a bucket that is
filled so far as one block, induces all its predecessors with array operations
(a stable counting order keeps them in scan order) and repeats until the bucket
brings nothing new.  The rounds of a bucket are as many as the longest run of
its byte, so the Python overhead does not depend on the length of the text.

A string of names can have as many symbols as it has places, so that buckets
are too small to work on at once.  Where it has more than ``MAX_BUCKETS`` of
them, names are refined by doubling instead: the rank of a place is its name,
then pairs of ranks, until all differ.
"""

from __future__ import annotations

import numpy as np

MAX_BUCKETS = 512


def _doubling(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names; only places that still tie are sorted again."""
    n = len(names)
    rank = names.astype(np.int64) + 1
    sa = np.argsort(rank, kind="stable")
    key = rank[sa]
    head = np.empty(n, bool)
    head[0] = True
    np.not_equal(key[1:], key[:-1], out=head[1:])
    # The rank of a group is the place of its first member: refining a group leaves all others alone.
    starts = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[sa] = starts + 1
    single = head & np.append(head[1:], True)
    open_ = np.flatnonzero(~single)
    step = 1
    while len(open_):
        at = sa[open_]
        nxt = at + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], 0)
        group = rank[at]
        order = np.argsort(group * (n + 2) + second, kind="stable")
        at, group, second = at[order], group[order], second[order]
        sa[open_] = at
        head = np.empty(len(at), bool)
        head[0] = True
        head[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        rank[at] = open_[first] + 1
        open_ = open_[~(head & np.append(head[1:], True))]
        step *= 2
    return sa


def _scan(text, prev, sa, heads, tails, starts, ends, size, left: bool):
    """One induction.  left: L suffixes from bucket heads upwards, else S suffixes from bucket ends downwards.

    prev[j] holds the byte before j, or -1 where the suffix at j - 1 is not of
    the type that this scan places.  Blocks of S entries are kept in falling order.
    """
    for c in range(size) if left else range(size - 1, -1, -1):
        if starts[c] == ends[c]:
            continue
        done = starts[c] if left else ends[c]
        fixed = False
        while True:
            if left:
                lo, hi = done, heads[c]
                if lo == hi:
                    if fixed:
                        break
                    fixed = True  # the LMS suffixes of the bucket come after its L suffixes
                    lo, hi = tails[c], ends[c]
                    if lo == hi:
                        break
                    block = sa[lo:hi]
                else:
                    block = sa[lo:hi]
                    done = hi
            else:
                lo, hi = tails[c], done
                if lo == hi:
                    if fixed:
                        break
                    fixed = True
                    lo, hi = starts[c], heads[c]
                    if lo == hi:
                        break
                    block = sa[lo:hi][::-1]
                else:
                    block = sa[lo:hi][::-1]
                    done = lo
            before = prev[block]
            keep = before >= 0
            before = before[keep]
            if not len(before):
                continue
            at = block[keep] - 1
            if len(before) < 24:
                if left:
                    for b, j in zip(before.tolist(), at.tolist(), strict=True):
                        sa[heads[b]] = j
                        heads[b] += 1
                else:
                    for b, j in zip(before.tolist(), at.tolist(), strict=True):
                        tails[b] -= 1
                        sa[tails[b]] = j
                continue
            order = np.argsort(before, kind="stable")
            count = np.bincount(before, minlength=size)
            at = at[order]
            base = 0
            for b in np.flatnonzero(count).tolist():
                k = int(count[b])
                part = at[base : base + k]
                base += k
                if left:
                    sa[heads[b] : heads[b] + k] = part
                    heads[b] += k
                else:
                    sa[tails[b] - k : tails[b]] = part[::-1]
                    tails[b] -= k


def _induce(text, is_l, sorted_lms, size, bounds):
    """The suffix array (or, from unsorted LMS positions, one ordered by LMS substrings)."""
    n = len(text)
    starts, ends = bounds
    sa = np.zeros(n, np.int32)
    prev = np.full(n, -1, np.int16 if size < 32000 else np.int32)
    left, right = prev[1:], text[:-1]
    np.copyto(left, right, where=is_l[:-1], casting="unsafe")
    # LMS suffixes at the ends of their buckets, in the given order.
    first = text[sorted_lms]
    order = np.argsort(first, kind="stable")
    count = np.bincount(first, minlength=size)
    tails = (ends - count).tolist()
    offset = np.concatenate(([0], np.cumsum(count)[:-1]))
    dest = np.repeat(ends - count - offset, count) + np.arange(len(first))
    sa[dest] = sorted_lms[order]
    heads = starts.tolist()
    starts_l, ends_l = starts.tolist(), ends.tolist()
    # The last suffix is L: the (virtual) end of the text, smaller than all, induces it first.
    c = int(text[n - 1])
    sa[heads[c]] = n - 1
    heads[c] += 1
    _scan(text, prev, sa, heads, tails, starts_l, ends_l, size, True)
    prev.fill(-1)
    np.copyto(left, right, where=~is_l[:-1], casting="unsafe")
    tails = list(ends_l)
    _scan(text, prev, sa, heads, tails, starts_l, ends_l, size, False)
    return sa


def suffix_array(text: np.ndarray, size: int = 256) -> np.ndarray:
    """Order of all suffixes of an integer array with symbols below ``size``; a proper prefix comes first."""
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    less = text[:-1] < text[1:]
    differ = text[:-1] != text[1:]
    # A run takes the type of its last member; the last suffix is L.
    run_end = np.flatnonzero(np.append(differ, True))
    kind = np.append(less[run_end[:-1]], False)
    is_s = np.repeat(kind, np.diff(np.concatenate(([-1], run_end))))
    is_l = ~is_s
    lms = (np.flatnonzero(is_s[1:] & is_l[:-1]) + 1).astype(np.int32)
    count = np.bincount(text, minlength=size)
    ends = np.cumsum(count)
    bounds = (ends - count, ends)
    m = len(lms)
    if m == 0:
        return _induce(text, is_l, lms, size, bounds)
    if m == 1:
        return _induce(text, is_l, lms, size, bounds)
    by_substring = _induce(text, is_l, lms, size, bounds)
    place = np.full(n, -1, np.int32)
    place[lms] = np.arange(m, dtype=np.int32)
    ordered = place[by_substring]
    ordered = ordered[ordered >= 0]
    # Names: adjacent LMS substrings differ or not.
    length = np.append(np.diff(lms), n - lms[-1] + 1).astype(np.int32) + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    cand = np.flatnonzero(same)
    wide = np.concatenate((text, np.zeros(16, text.dtype)))
    pa_, pb = lms[a[cand]], lms[b[cand]]
    left = length[a[cand]]
    last = m - 1
    keep = (a[cand] != last) & (b[cand] != last)  # the last one ends at the end of the text, like no other
    same[cand[~keep]] = False
    cand, pa_, pb, left = cand[keep], pa_[keep], pb[keep], left[keep]
    off = 0
    while len(cand):
        eq = wide[pa_ + off] == wide[pb + off]
        same[cand[~eq]] = False
        off += 1
        go = eq & (left > off)
        cand, pa_, pb, left = cand[go], pa_[go], pb[go], left[go]
    names_sorted = np.concatenate(([0], np.cumsum(~same))).astype(np.int32)
    names = np.empty(m, np.int32)
    names[ordered] = names_sorted
    total = int(names_sorted[-1]) + 1
    if total == m:
        order = ordered
    elif total <= MAX_BUCKETS:
        order = suffix_array(names.astype(np.int16 if total < 32000 else np.int32), total)
    else:
        order = _doubling(names)
    return _induce(text, is_l, lms[order], size, bounds)


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): common prefix of each suffix with its predecessor in the order, by text position.

    plcp[i] >= plcp[i - 1] - 1, with equality where the bytes before both
    suffixes agree; so only the other, irreducible, places are compared (eight
    bytes at a time), and all others follow from the place before.
    """
    n = len(text)
    phi = np.empty(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    plcp = np.zeros(n, np.int64)
    if n < 2:
        return plcp, phi
    i = np.arange(n)
    reducible = (i > 0) & (phi > 0)
    reducible &= text[i - 1] == text[phi - 1]
    reducible[1:] &= phi[:-1] >= 0
    words = np.zeros(n + 16, np.uint8)
    words[:n] = text
    word = np.lib.stride_tricks.as_strided(words[: n + 8].view(), (n + 8, 8), (1, 1))
    at = np.flatnonzero(~reducible & (phi >= 0))
    to = phi[at]
    room = n - np.maximum(at, to)
    got = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    off = 0
    while len(live):
        p, q = at[live] + off, to[live] + off
        x = (word[p].view(np.uint64) ^ word[q].view(np.uint64)).ravel()
        low = x & (~x + np.uint64(1))
        bits = np.where(x == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64)) >> 3)
        got[live] = off + bits
        off += 8
        live = live[(x == 0) & (room[live] > off)]
    plcp[at] = np.minimum(got, room)
    root = np.maximum.accumulate(np.where(reducible, 0, i))
    out = plcp[root] - (i - root)
    return np.maximum(out, 0), phi
