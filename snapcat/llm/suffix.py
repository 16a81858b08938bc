"""Suffix order by the difference-cover algorithm (cover {1, 2} modulo 3), up to a prefix depth.

Suffixes at positions 1 and 2 modulo 3 are the sample. Their triples are sorted and named; if names are not yet
distinct and do not yet cover the depth, the string of names is ranked by the same algorithm. The remaining suffixes
are sorted by their first symbol and the rank of the sample suffix after it, and both orders are merged. With a depth,
suffixes that agree in that many symbols may share a rank: the recursion ends as soon as names cover it.
"""

from __future__ import annotations

import numpy as np


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 1, equal for equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.argsort(keys)
    new = np.empty(len(keys), np.int64)
    new[0] = 1
    sorted_ = keys[order]
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:], casting="unsafe")
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def _named(keys: np.ndarray) -> np.ndarray:
    """_dense(), from a table instead of a sort where the keys are small."""
    if len(keys) and int(keys.max()) < 4 * len(keys) + 65536:
        there = np.zeros(int(keys.max()) + 1, np.int64)
        there[keys] = 1
        return np.cumsum(there)[keys]
    return _dense(keys)


def _joined(a: np.ndarray, b: np.ndarray, most_b: int) -> np.ndarray:
    """One key that orders by a, then b (both from 0); a is made dense first where the product would not fit."""
    if len(a) and int(a.max() + 1) * (most_b + 1) >= 1 << 62:
        a = _dense(a)
    return a * np.int64(most_b + 1) + b


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """Ranks (from 1) of all suffixes of s (symbols from 1); order by the first `depth` symbols at least.

    A suffix that differs from another one within `depth` symbols has a different rank, in the right order; the end
    of the string comes before every symbol.
    """
    n = len(s)
    p = np.zeros(n + 3, np.int64)
    p[:n] = s
    top = int(p.max()) if n else 0
    if n < 3 or depth <= 3:
        out = p[:n]
        for k in range(1, min(depth, 3)):
            out = _joined(out, p[k : k + n], top)
        return _named(out)
    sample = np.concatenate((np.arange(1, n, 3), np.arange(2, n, 3)))
    ones = len(range(1, n, 3))
    names = _named(_joined(_joined(p[sample], p[sample + 1], top), p[sample + 2], top))
    if int(names.max()) < len(names):
        gap = np.zeros(3, np.int64)  # names of one residue do not run on into those of the other
        inner = suffix_ranks(np.concatenate((names[:ones], gap, names[ones:])) + 1, -(-depth // 3))
        names = _named(np.concatenate((inner[:ones], inner[ones + 3 :])))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names
    high = int(names.max())
    # the remaining suffixes, then the merge: a sample suffix is compared by one symbol or by two, so that ranks
    # of sample suffixes decide; needles are in order, which makes the searches run along
    one, two, zero = sample[:ones], sample[ones:], np.arange(0, n, 3)
    by_one = lambda at: _joined(p[at], rank[at + 1], high)
    pair = _joined(p[:-1], p[1:], top)
    if (int(pair.max()) + 1) * (high + 1) >= 1 << 62:
        pair = _named(pair)
    by_two = lambda at: pair[at] * np.int64(high + 1) + rank[at + 2]
    one, two = one[np.argsort(names[:ones], kind="stable")], two[np.argsort(names[ones:], kind="stable")]
    mid = by_one(zero)
    order = np.argsort(mid, kind="stable")
    zero, mid = zero[order], mid[order]
    mid2, s1, s2 = by_two(zero), by_one(one), by_two(two)
    out = np.empty(n, np.int64)
    out[zero] = np.searchsorted(mid, mid) + np.searchsorted(s1, mid) + np.searchsorted(s2, mid2)
    counts = np.bincount(names, minlength=high + 1)
    below = np.cumsum(counts) - counts
    out[one] = below[rank[one]] + np.searchsorted(mid, s1)
    out[two] = below[rank[two]] + np.searchsorted(np.maximum.accumulate(mid2), s2)
    return out + 1


def prefix_classes(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Class numbers (from 0) of the substrings data[i : i + width] at the given positions; equal bytes, equal class.

    All suffixes are put in order, then the prefixes of neighbours are compared. Positions must leave `width` bytes.
    """
    there = np.bincount(data, minlength=256) > 0
    ranks = suffix_ranks(np.cumsum(there)[data], width)[starts]
    order = np.argsort(ranks, kind="stable")
    at = starts[order]
    new = np.zeros(len(at), bool)
    wide = np.zeros(len(data), np.uint64)  # eight bytes from each position on
    for k in range(min(8, len(data))):
        wide[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    for k in [*range(0, width - 7, 8), *([width - 8] if width >= 8 else [])]:
        part = wide[at + k]
        new[1:] |= part[1:] != part[:-1]
    if width < 8:
        for k in range(width):
            new[1:] |= data[at[1:] + k] != data[at[:-1] + k]
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(new)
    return out
