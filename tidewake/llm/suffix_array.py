"""Suffix arrays by induced sorting and permuted common prefixes, in numpy.

Suffixes are classified as S (smaller than the next) or L; the leftmost S ones
(LMS) are sorted by sorting their substrings and naming them; unless all names
differ, the suffixes of the string of names are sorted in the same way, and all
others follow from them in two linear scans. Over a small alphabet a scan takes
a bucket of equal first characters at a time: all entries of it that are known
push their predecessors in order, those that fall into the bucket itself make
the next wave. Names have about as many buckets as entries, so their scans take
one entry at a time.
"""

from __future__ import annotations

import numpy as np

NONE = np.uint16(0xFFFF)
#: Buckets are scanned as arrays if they are few and have about so many entries at least.
MOST_BUCKETS, ENTRIES = 4096, 64


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of an array of small non-negative integers whose last element is 0 and the only 0."""
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable").astype(np.int32)
    s_type, counts = _s_types(text), np.bincount(text)
    lms = np.flatnonzero(s_type & np.r_[False, ~s_type[:-1]]).astype(np.int32)
    induce = _by_buckets if len(counts) <= MOST_BUCKETS and n >= ENTRIES * len(counts) else _by_entries
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = induce(text, s_type, counts, lms)
    by_substring = rough[is_lms[rough]]
    names, distinct = _names(text, lms, by_substring)
    if distinct < len(lms):
        by_substring = lms[suffix_array(names)]
    return induce(text, s_type, counts, by_substring)


def _s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; a run of one character takes the type of its end."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    rises = text[differs] < text[differs + 1]
    out = np.ones(n, bool)
    if len(differs):
        lengths = np.diff(np.r_[-1, differs])
        out[: differs[-1] + 1] = np.repeat(rises, lengths)
    return out


def _by_entries(text, s_type, counts, lms) -> np.ndarray:
    """The array that the given order of LMS positions induces, an entry at a time."""
    chars, smaller, ends = text.tolist(), s_type.tolist(), np.cumsum(counts)
    sa, tails, heads = [-1] * len(chars), ends.tolist(), (ends - counts).tolist()
    for p in reversed(lms.tolist()):
        c = chars[p]
        tails[c] -= 1
        sa[tails[c]] = p
    for p in sa:
        if p > 0 and not smaller[p - 1]:
            c = chars[p - 1]
            sa[heads[c]] = p - 1
            heads[c] += 1
    tails = ends.tolist()
    for i in range(len(sa) - 1, -1, -1):
        p = sa[i]
        if p > 0 and smaller[p - 1]:
            c = chars[p - 1]
            tails[c] -= 1
            sa[tails[c]] = p - 1
    return np.array(sa, np.int32)


def _by_buckets(text, s_type, counts, lms) -> np.ndarray:
    """The same a bucket at a time."""
    before, ends = np.r_[NONE, text[:-1]], np.cumsum(counts)
    pred_s = np.where(np.r_[False, s_type[:-1]], before, NONE)
    pred_l = np.where(np.r_[False, ~s_type[:-1]], before, NONE)
    starts = ends - counts
    sa = np.empty(len(text), np.int32)
    first = text[lms]
    order = np.argsort(first, kind="stable")
    of_bucket = np.bincount(first, minlength=len(ends))
    seeds = np.split(lms[order], np.cumsum(of_bucket)[:-1])
    heads, tails = starts.copy(), ends.copy()

    for c in range(len(ends)):
        done = starts[c]
        while done < heads[c]:
            entries, done = sa[done : heads[c]], heads[c]
            _push(sa, entries, pred_l, heads, 1)
        if len(seeds[c]):
            _push(sa, seeds[c], pred_l, heads, 1)
    for c in range(len(ends) - 1, -1, -1):
        done = ends[c]
        while tails[c] < done:
            entries, done = sa[tails[c] : done][::-1], tails[c]
            _push(sa, entries, pred_s, tails, -1)
        if starts[c] < heads[c]:
            _push(sa, sa[starts[c] : heads[c]][::-1], pred_s, tails, -1)
    sa[0] = len(text) - 1
    return sa


def _push(sa, entries, pred, edge, step) -> None:
    """Put the predecessors of entries at the edge of their buckets, in order."""
    chars = pred[entries]
    keep = np.flatnonzero(chars != NONE)
    if not len(keep):
        return
    chars = chars[keep]
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    heads = np.flatnonzero(np.r_[True, chars[1:] != chars[:-1]])
    which, counts = chars[heads], np.diff(np.r_[heads, len(chars)])
    base = edge[which] - (step < 0)
    place = np.repeat(base - step * heads, counts) + step * np.arange(len(chars))
    sa[place] = entries[keep[order]] - 1
    edge[which] += step * counts


def _names(text, lms, by_substring):
    """Names (ranks of substrings, equal ones alike) of the LMS positions in text order, and how many there are."""
    n = len(text)
    length = np.empty(n, np.int32)
    length[lms] = np.diff(np.r_[lms, n - 1]) + 1
    a, b = by_substring[:-1], by_substring[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        x, y = a[live], b[live]
        equal = text[x + k] == text[y + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal & (length[x] > k)]
    rank = np.empty(n, np.int32)
    rank[by_substring] = np.cumsum(np.r_[0, ~same])
    return rank[lms], int(len(by_substring) - np.count_nonzero(same))


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: its lexicographic predecessor (itself for the first) and their common prefix.

    Only irreducible positions (whose left neighbours differ) are compared; a
    reducible one has the prefix of the position before, less one.
    """
    n = len(text)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = sa[0]
    at = np.arange(n)
    left, other = np.r_[NONE, text[:-1]], np.where(phi > 0, text[phi - 1], NONE)
    fresh = (left != other) | (at == 0) | (phi == 0) | (phi == at)
    where = np.flatnonzero(fresh)
    x, y = where.astype(np.int64), phi[where].astype(np.int64)
    common = np.zeros(len(where), np.int64)
    live = np.flatnonzero(x != y)
    step = 32
    pad = np.r_[text, np.zeros(step, text.dtype)]
    windows = np.lib.stride_tricks.sliding_window_view(pad, step)
    for low in range(0, len(live), 1 << 16):
        part = live[low : low + (1 << 16)]
        while len(part):
            a, b = windows[x[part] + common[part]], windows[y[part] + common[part]]
            unlike = a != b
            stop = unlike.any(axis=1)
            common[part] += np.where(stop, unlike.argmax(axis=1), step)
            part = part[~stop]
    group = np.cumsum(fresh) - 1
    return phi, (common[group] - (at - where[group])).astype(np.int32)
