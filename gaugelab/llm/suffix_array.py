"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Suffixes are classified as smaller or larger than their successor. The leftmost
smaller ones cut the text into substrings, which one induction sorts; their names
make a shorter text that is sorted the same way, and a second induction spreads
that order to all suffixes.

For a small alphabet an induction walks the buckets of letters and handles a
bucket's entries together: linear work in a number of array operations that
depends on the alphabet only. The names of a shorter text are too many for that;
there every suffix is ranked by its letters up to the next leftmost-smaller one,
in rounds of doubling length, and then by the rank of that one. Such stretches
are short, so a few rounds do.
"""

from __future__ import annotations

import numpy as np

#: Texts up to this length are sorted directly.
SHORT = 256
#: Alphabets up to this size are walked bucket by bucket.
FEW_LETTERS = 1024


def _classify(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one (the end mark) is."""
    n = len(s)
    smaller = np.ones(n, bool)
    if n > 1:
        differs = s[1:] != s[:-1]
        # The next place where neighbours differ decides for all equal letters before it.
        place = np.where(differs, np.arange(n - 1), n)
        place = np.minimum.accumulate(place[::-1])[::-1]
        known = place < n
        smaller[:-1] = False
        smaller[:-1][known] = s[place[known]] < s[place[known] + 1]
    return smaller


def _into(found: np.ndarray, letters: np.ndarray, at: np.ndarray, sa: np.ndarray, up: bool) -> None:
    """Append entries to the fronts (or ends) of their buckets, in order."""
    order = np.argsort(letters, kind="stable")
    letters, found = letters[order], found[order]
    first = np.flatnonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))
    size = np.diff(np.append(first, len(letters)))
    heads = letters[first]
    if up:
        sa[np.repeat(at[heads] - first, size) + np.arange(len(letters))] = found
        at[heads] += size
    else:
        sa[np.repeat(at[heads] - 1 + first, size) - np.arange(len(letters))] = found
        at[heads] -= size


def _induce(s: np.ndarray, smaller: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, in the order that the given order of leftmost-smaller ones implies."""
    k = len(starts) - 1
    sa = np.full(len(s), -1, np.int32)
    ends = starts[1:].copy()
    _into(lms[::-1], s[lms[::-1]], ends, sa, False)
    lms_from = ends
    heads = starts[:-1].copy()

    def larger_before(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            _into(before, s[before], heads, sa, True)

    for c in range(k):
        if starts[c] == starts[c + 1]:
            continue
        done = starts[c]
        while done < heads[c]:  # entries of this bucket may add to it
            upto = heads[c]
            larger_before(sa[done:upto])
            done = upto
        if lms_from[c] < starts[c + 1]:
            larger_before(sa[lms_from[c] : starts[c + 1]].copy())

    tails = starts[1:].copy()

    def smaller_before(entries: np.ndarray) -> None:
        before = entries[entries > 0] - 1
        before = before[smaller[before]]
        if len(before):
            _into(before, s[before], tails, sa, False)

    for c in range(k - 1, -1, -1):
        if starts[c] == starts[c + 1]:
            continue
        done = starts[c + 1]
        while done > tails[c]:
            upto = tails[c]
            smaller_before(sa[upto:done][::-1])
            done = upto
        if heads[c] > starts[c]:
            smaller_before(sa[starts[c] : heads[c]][::-1])
    sa[0] = len(s) - 1
    return sa


def _same_substrings(s: np.ndarray, one: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether substrings of equal length are equal, letter by letter for all at once."""
    same = np.ones(len(one), bool)
    going = np.arange(len(one))
    step = 0
    while len(going):
        equal = s[one[going] + step] == s[other[going] + step]
        same[going[~equal]] = False
        step += 1
        going = going[equal]
        going = going[length[going] > step]
    return same


def _direct(s: np.ndarray) -> np.ndarray:
    data = s.tolist()
    return np.array(sorted(range(len(data)), key=lambda i: data[i:]), np.int32)


def _dense(keys: np.ndarray) -> np.ndarray:
    """Rank of each key, equal for equal keys."""
    order = np.argsort(keys)
    k = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], k[1:] != k[:-1]]))
    return rank


def _ranked(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Rank of each suffix by its letters, with their class, up to the next leftmost-smaller suffix, and by ``final`` of that.

    The leftmost-smaller suffixes also stand at the end of the array as last
    letters, ranked by letter and ``final``. Ranks are those of the place of a key
    among all, so only keys that still tie are sorted again.
    """
    n, m = len(s), len(lms)
    # Places left to the next leftmost-smaller suffix; the end mark has none.
    following = np.searchsorted(lms, np.arange(n), side="right")
    left = np.append(lms, n).astype(np.int64)[following] - np.arange(n)
    left[n - 1] = 0
    letter = s.astype(np.int64) * 2 + smaller
    rank = _placed(np.concatenate([letter * (m + 1), letter[lms] * (m + 1) + 1 + final]))
    size = np.bincount(rank, minlength=n + m)
    tied = np.flatnonzero((size[rank[:n]] > 1) & (left >= 1))
    reach = 1
    while len(tied):
        # Ties have the same letters so far, so all of a tie end here, or none does.
        here = left[tied] == reach
        ahead = np.where(here, n + following[tied], tied + reach)
        old = rank[tied]
        pair = old * (n + m + 1) + rank[ahead]
        order = np.argsort(pair)
        pair, tied, old = pair[order], tied[order], old[order]
        at = np.arange(len(tied))
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        rank[tied] = old + np.maximum.accumulate(np.where(first, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        reach *= 2
        alone = first & np.append(first[1:], True)
        tied = tied[~alone]
        tied = tied[left[tied] >= reach]
    return rank[:n]


def _placed(keys: np.ndarray) -> np.ndarray:
    """For each key how many are smaller."""
    order = np.argsort(keys)
    k = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(len(k)), 0))
    return rank


def _names(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, letters: int, starts: np.ndarray | None) -> np.ndarray:
    """Names of the leftmost-smaller substrings, in text order."""
    n = len(s)
    if starts is None:
        return _dense(_ranked(s, smaller, lms, np.zeros(len(lms), np.int64))[lms])
    order = _induce(s, smaller, starts, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    # A substring reaches to the next one's first letter, included; the end mark is one of its own.
    length = np.ones(n, np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    fresh = np.ones(len(order), bool)
    alike = np.flatnonzero(length[order[1:]] == length[order[:-1]])
    fresh[alike + 1] = ~_same_substrings(s, order[alike], order[alike + 1], length[order[alike]])
    named = np.empty(n, np.int64)
    named[order] = np.cumsum(fresh) - 1
    return named[lms]


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Order of the suffixes of a text over 0..letters-1 that ends in its only 0."""
    n = len(s)
    if n <= SHORT:
        return _direct(s)
    few = letters <= FEW_LETTERS
    s = s.astype(np.uint16 if few else np.int64, copy=False)  # short letters are sorted by counting
    smaller = _classify(s)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    starts = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=letters))]) if few else None
    names = _names(s, smaller, lms, letters, starts)
    most = int(names.max())
    if most + 1 < len(lms):
        order = suffix_array(names, most + 1)  # the end mark is the smallest and alone
    else:
        order = np.empty(len(lms), np.int64)
        order[names] = np.arange(len(lms))
    if few:
        return _induce(s, smaller, starts, lms[order])
    final = np.empty(len(lms), np.int64)
    final[order] = np.arange(len(lms))
    return np.argsort(_ranked(s, smaller, lms, final)).astype(np.int32)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int, stride: int = 64) -> np.ndarray:
    """For every entry of the suffix array how many letters it shares with the entry before, up to ``most``.

    Computed in text order, where the value falls by at most one from a suffix to
    the next: stretches of ``stride`` suffixes go in step, each from what its last
    suffix left.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate([s, np.zeros(most + 1, s.dtype)])
    permuted = np.zeros(n, np.int64)
    bases = np.arange(0, n, stride)
    held = np.zeros(len(bases), np.int64)
    for t in range(min(stride, n)):
        i = bases + t
        inside = i < n
        i, value = i[inside], np.maximum(held[inside] - 1, 0)
        j = before[i]
        value[j < 0] = 0
        going = np.flatnonzero((j >= 0) & (value < most))
        while len(going):
            v = value[going]
            a, b = i[going] + v, j[going] + v
            equal = (padded[a] == padded[b]) & (a < n) & (b < n)
            going = going[equal]
            value[going] += 1
            going = going[value[going] < most]
        permuted[i] = value
        held[inside] = value
    return permuted[sa]
