"""Suffix arrays by linear grouping, for many short texts side by side.

Suffixes are grouped by their Lyndon prefix, the longest prefix that is a Lyndon word. At
first a group is a first symbol. Groups are processed in descending order: each suffix of
the group points to the nearest suffix before it in a smaller group (its previous smaller
one), and what is pointed to has its prefix lengthened by the group's; so it moves to a
new group right behind the rest of its own, by how many pointers it gets. After that every
group is final. In ascending order each suffix then settles the one before it in the text
and, along the pointers, those that it extends: each takes the next free place of its
group. No names are recomputed and nothing recurses.

The texts don't depend on each other, so one step processes the highest open group of every
text. A suffix settles only larger ones, so a step of the second phase takes, of every text, all
places that are settled without a gap, over as many groups as they span: some sqrt(n) steps.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    at = np.cumsum(sizes) - sizes
    return np.repeat(starts - at, sizes) + np.arange(int(sizes.sum()))


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the one before."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def suffix_arrays(symbols: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """symbols: the texts one after another, each ended by its only 0. lo: where each begins.

    Returns the places of all suffixes: those of a text stand where the text stands, in ascending order.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    # Place 0 is a stop before the first text; a text's end is the stop of the next one.
    lo = lo.astype(np.int64) + 1
    hi = np.concatenate([lo[1:], [n + 1]])
    text = np.concatenate([[0], symbols]).astype(np.int64)
    key = text + np.concatenate([[0], np.repeat(np.arange(1, len(lo) + 1) * (int(text.max()) + 1), hi - lo)])
    sa = np.argsort(key, kind="stable")
    isa = np.empty(n + 1, np.int64)
    isa[sa] = np.arange(n + 1)
    at = np.flatnonzero(_firsts(key[sa]))
    size = np.diff(np.concatenate([at, [n + 1]]))
    group = np.empty(n + 1, np.int64)
    group[sa] = np.repeat(at, size)
    size_of = np.zeros(n + 1, np.int64)
    size_of[at] = size
    start_at_end = np.zeros(n + 1, np.int64)
    start_at_end[at + size - 1] = at
    prev = np.full(n + 1, -1, np.int64)
    chosen = np.zeros(n + 1, bool)
    stop = text == 0

    low, end = lo[hi - lo > 1], hi[hi - lo > 1] - 1
    while len(end):
        begin = start_at_end[end]
        who = sa[_ranges(begin, end - begin + 1)]
        own = np.repeat(begin, end - begin + 1)
        j = who - 1
        open_ = np.flatnonzero(group[j] >= own)
        while len(open_):
            k = j[open_]
            j[open_] = np.where(prev[k] >= 0, prev[k], k - 1)
            open_ = open_[group[j[open_]] >= own[open_]]
        prev[who] = j
        target = np.sort(j[~stop[j]])
        if len(target):
            new = _firsts(target)
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate([first, [len(target)]]))
            target = target[first]
            old = group[target]
            order = np.lexsort((count, old))
            target, old, count = target[order], old[order], count[order]
            head = np.flatnonzero(_firsts(old))
            moved = np.diff(np.concatenate([head, [len(old)]]))
            rest = size_of[old[head]] - moved
            to = _ranges(old[head] + rest, moved)
            # What stands there and isn't moved takes the places that become free.
            chosen[target] = True
            there = sa[to]
            there = there[~chosen[there]]
            chosen[target] = False
            came = isa[target]
            free = np.sort(came[came < np.repeat(old[head] + rest, moved)])
            sa[free], isa[there] = there, free
            sa[to], isa[target] = target, to
            size_of[old[head]] = rest
            left = rest > 0
            start_at_end[(old[head] + rest - 1)[left]] = old[head][left]
            first = np.flatnonzero(_firsts(old, count))
            sizes = np.diff(np.concatenate([first, [len(to)]]))
            group[target] = np.repeat(to[first], sizes)
            size_of[to[first]] = sizes
            start_at_end[to[first] + sizes - 1] = to[first]
        end = begin - 1
        on = end > low
        low, end = low[on], end[on]

    out = np.full(n + 1, -1, np.int64)
    out[0], out[lo] = 0, hi - 1
    place = np.arange(n + 1)  # at a group's start its next free place
    done = stop.copy()
    claim = np.full(n + 1, n + 1)  # the first settled place whose chain reaches a suffix
    holes, at = np.flatnonzero(out < 0), lo
    while len(at):
        # All that is settled without a gap, of every text; what follows from it lies behind it.
        holes = holes[out[holes] < 0]
        upto = np.minimum(hi, np.append(holes, n + 1)[np.searchsorted(holes, at)])
        settled = _ranges(at, upto - at)
        s, r, reached = out[settled] - 1, settled, []
        while len(s):
            open_ = ~done[s]
            s, r = s[open_], r[open_]
            before = claim[s]
            np.minimum.at(claim, s, r)
            first = (claim[s] == r) & (r < before)
            s, r = s[first], r[first]
            reached.append(s)
            s = prev[s]
        s = np.unique(np.concatenate(reached)) if reached else out[:0]
        s = s[np.lexsort((claim[s], group[s]))]
        if len(s):
            begin = np.flatnonzero(_firsts(group[s]))
            count = np.diff(np.append(begin, len(s)))
            own = group[s[begin]]
            out[_ranges(place[own], count)] = s
            place[own] += count
            done[s] = True
        on = upto < hi
        at, hi = upto[on], hi[on]
    return out[1:] - 1
