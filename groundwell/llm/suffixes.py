"""Suffix arrays by induced sorting, in array operations.

Suffixes are classified as smaller or larger than their successor; the leftmost-smaller
substrings are sorted by induction, named, and where names repeat, the string of names is sorted
by the same function. The order of all suffixes is then induced in two scans of the buckets.
A scan takes all known suffixes of a bucket in one step; only suffixes that a bucket induces in
itself take further steps. Names are written as two digits of a smaller alphabet, so that buckets
stay few and full.
"""

from __future__ import annotations

import numpy as np

#: Strings of that length are sorted without further recursion.
SHORT = 1 << 18


def _smaller(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the end is smaller than all."""
    n = len(s)
    smaller = np.zeros(n, bool)
    smaller[:-1] = s[:-1] < s[1:]
    # Within a run of equal letters the first unlike letter after it decides.
    same = np.flatnonzero(s[:-1] == s[1:])
    last = same[np.append(np.flatnonzero(np.diff(same) > 1), len(same) - 1)] if len(same) else same
    smaller[same] = smaller[last[np.searchsorted(last, same)] + 1]
    return smaller


def _place(sa: np.ndarray, bound: np.ndarray, at: np.ndarray, letters: np.ndarray, sign: int) -> None:
    """Put suffixes, in order, at the open ends of the buckets of their letters."""
    n = len(at)
    if n == 1:
        letter = letters[0]
        sa[bound[letter] + (sign - 1) // 2] = at[0]
        bound[letter] += sign
        return
    order = letters.argsort(kind="stable")
    letters, at = letters[order], at[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(letters[1:], letters[:-1], out=new[1:])
    first = new.nonzero()[0]
    sizes = np.empty(len(first), np.int64)
    sizes[:-1] = first[1:] - first[:-1]
    sizes[-1] = n - first[-1]
    own = letters[first]
    if sign > 0:
        sa[np.arange(n) + (bound[own] - first).repeat(sizes)] = at
    else:
        sa[(bound[own] - 1 + first).repeat(sizes) - np.arange(n)] = at
    bound[own] += sign * sizes


def _induced(
    s: np.ndarray, smaller: np.ndarray, counts: np.ndarray, seeds: np.ndarray
) -> np.ndarray:
    """All suffixes in the order induced by ``seeds``, leftmost-smaller ones in their order."""
    n = len(s)
    ends = np.cumsum(counts)
    heads = ends - counts
    first = heads.copy()
    used = np.flatnonzero(counts)
    sa = np.empty(n, np.int32)
    seed_letters = s[seeds]
    by_letter = np.argsort(seed_letters, kind="stable")
    seeds = seeds[by_letter]
    seed_ends = np.cumsum(np.bincount(seed_letters, minlength=len(counts)))

    # Whether the suffix to the left of each is one that the scan puts in place.
    after_larger = np.zeros(n + 1, bool)
    np.logical_not(smaller, out=after_larger[1:])
    after_smaller = np.zeros(n + 1, bool)
    after_smaller[1:] = smaller

    def larger_before(block: np.ndarray) -> None:
        at = block[after_larger[block]]
        if len(at):
            at = at - 1
            _place(sa, heads, at, s[at], 1)

    larger_before(np.array([n], np.int32))
    for c in used.tolist():
        done = first[c]
        while done < heads[c]:
            block = sa[done : heads[c]]
            done = heads[c]
            larger_before(block)
        block = seeds[seed_ends[c - 1] if c else 0 : seed_ends[c]]
        if len(block):
            larger_before(block)
    tails = ends.copy()

    def smaller_before(block: np.ndarray) -> None:
        at = block[after_smaller[block]]
        if len(at):
            at = at[::-1] - 1
            _place(sa, tails, at, s[at], -1)

    for c in used[::-1].tolist():
        done = ends[c]
        while tails[c] < done:
            block = sa[tails[c] : done]
            done = tails[c]
            smaller_before(block)
        if heads[c] > first[c]:
            smaller_before(sa[first[c] : heads[c]])
    return sa


def _names(s: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of sorted substrings, equal for equal ones. ``size`` counts their letters."""
    same = np.zeros(len(starts), bool)
    open_ = np.flatnonzero(size[1:] == size[:-1]) + 1
    depth = 0
    while len(open_):
        over = size[open_] <= depth
        same[open_[over]] = True
        open_ = open_[~over]
        open_ = open_[s[starts[open_] + depth] == s[starts[open_ - 1] + depth]]
        depth += 1
    return np.cumsum(~same) - 1


def _doubled(s: np.ndarray) -> np.ndarray:
    """The suffix array of a short string, by sorting prefixes of doubling length."""
    n, width = len(s), 1
    rank = s.astype(np.int64) + 1
    while True:
        key = rank * (int(rank.max()) + 1)
        key[:-width] += rank[width:]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1]))
        width *= 2
        if rank[order[-1]] == n or width >= n:
            return order.astype(np.int32)


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """The starts of all suffixes of ``s`` (numbers below ``alphabet``) in order.

    The recursion ends where names are unlike, or with a string of ``SHORT`` names or fewer.
    """
    n = len(s)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    if n <= SHORT:
        return _doubled(s)
    # Narrow letters are sorted by radix.
    s = s.astype(np.min_scalar_type(max(alphabet - 1, 0)))
    smaller = _smaller(s)
    counts = np.bincount(s, minlength=alphabet)
    inner = np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1
    if len(inner) > 1:
        is_inner = np.zeros(n, bool)
        is_inner[inner] = True
        sa = _induced(s, smaller, counts, inner)
        ordered = sa[is_inner[sa]]
        # A substring ends with the first letter of the next; the last one is like no other.
        span = np.zeros(n, np.int32)
        span[inner[:-1]] = np.diff(inner) + 1
        span[inner[-1]] = n + 1
        names = _names(s, ordered, span[ordered])
        kinds = int(names[-1]) + 1
        if kinds < len(inner):
            text = np.empty(n, np.int64)
            text[ordered] = names
            text = text[inner]
            if 2 * len(inner) <= 0.8 * n or kinds > n // 4:
                base = int(np.ceil(np.sqrt(kinds)))
                digits = np.stack([text // base, text % base], axis=1).ravel()
                order = suffix_array(digits.astype(np.int32), base)
                order = order[order % 2 == 0] // 2
            else:
                order = suffix_array(text.astype(np.int32), kinds)
            ordered = inner[order]
        inner = ordered
    return _induced(s, smaller, counts, inner)


def permuted_common_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of ``s`` the letters its suffix shares with the one before it in order.

    A suffix whose predecessor in order is preceded by the same letter shares one less than the
    suffix to its left; only the others are compared letter by letter.
    """
    n = len(s)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    fresh = np.ones(n, bool)
    some = np.flatnonzero((before > 0) & (np.arange(n) > 0))
    fresh[some] = s[some - 1] != s[before[some] - 1]
    shared = np.zeros(n, np.int64)
    open_ = np.flatnonzero(fresh & (before >= 0))
    depth = 0
    while len(open_):
        open_ = open_[np.maximum(open_, before[open_]) + depth < n]
        open_ = open_[s[open_ + depth] == s[before[open_] + depth]]
        depth += 1
        shared[open_] = depth
    left = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    return np.maximum(shared[left] - (np.arange(n) - left), 0)
