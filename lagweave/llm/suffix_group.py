"""Suffix arrays by linear grouping, for many independent strings side by side.

First phase: suffixes are grouped by their first symbol; groups are processed in
descending order. For each member of a group its pointer goes to the nearest
earlier suffix of a lower group. The suffixes pointed at leave their groups for
new ones right above, those that more members point at above those of fewer; so
that in the end a group holds the suffixes with one Lyndon prefix. Second phase:
from the smallest suffix on, the one before each placed suffix, and those along
its pointers, take the next place of their group. Nothing is renamed and no
step recurses.

Strings are processed in lock step: each numpy call handles the current group (or
the current place) of every string at once.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each pair, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def suffix_arrays(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each string symbols[offsets[b]:offsets[b + 1]] of positive integers, its suffixes in ascending order, as positions in symbols; strings follow one another."""
    sizes = np.diff(offsets)
    n_s = len(sizes)
    if not n_s or not len(symbols):
        return np.zeros(0, np.int64)
    # Layout: a guard before each string and an end mark after it, so that positions need no bounds.
    base = offsets[:-1] + 2 * np.arange(n_s)
    total = len(symbols) + 2 * n_s
    of = np.repeat(np.arange(n_s), sizes + 2)
    text = np.zeros(total, np.int64)
    at = _ranges(base + 1, sizes)
    text[at] = symbols
    guard = np.zeros(total, bool)
    guard[base] = True
    text[base] = -1
    order = np.lexsort((text, of))  # the guard is first in each string and keeps slot base
    slot = np.empty(total, np.int64)
    slot[order] = np.arange(total)
    sa = order.copy()
    new = np.ones(total, bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (of[order][1:] != of[order][:-1])
    starts = np.flatnonzero(new)
    size = np.zeros(total + 1, np.int64)
    size[starts] = np.diff(np.append(starts, total))
    begin = np.zeros(total + 1, np.int64)  # of the group that ends before a slot
    begin[starts + size[starts]] = starts
    group = np.empty(total, np.int64)
    group[order] = np.repeat(starts, size[starts])
    group[base] = -1
    prev = np.arange(total) - 1
    top = base + sizes + 2
    live = np.flatnonzero(sizes > 0)
    floor = base + 2  # the end mark's group is last and points nowhere
    marked = np.zeros(total, bool)
    while len(live):
        end = top[live]
        start = begin[end]
        own = _ranges(start, end - start)
        member = sa[own]
        mine = np.repeat(start, end - start)
        todo = np.arange(len(member))
        while len(todo):
            m = member[todo]
            p = prev[m]
            high = group[p] >= mine[todo]
            todo, m, p = todo[high], m[high], p[high]
            prev[m] = prev[p]
        target = prev[member]
        target = target[~guard[target]]
        if len(target):
            target, times = np.unique(target, return_counts=True)
            g = group[target]
            o = np.lexsort((times, g))
            target, times, g = target[o], times[o], g[o]
            first = np.ones(len(g), bool)
            first[1:] = g[1:] != g[:-1]
            gs = g[first]
            moved = np.diff(np.append(np.flatnonzero(first), len(g)))
            g_end = gs + size[gs]
            tail = g_end - moved
            tail_slots = _ranges(tail, moved)
            old = slot[target]
            leaving = old < np.repeat(tail, moved)
            marked[old] = True
            stays = tail_slots[~marked[tail_slots]]
            marked[old] = False
            if len(stays):
                # Both lists are in order of their group, and each group has as many of one as of the other.
                free = np.sort(old[leaving])
                moving = sa[stays]
                sa[free] = moving
                slot[moving] = free
            sa[tail_slots] = target
            slot[target] = tail_slots
            sub = first.copy()
            sub[1:] |= times[1:] != times[:-1]
            sub_at = np.flatnonzero(sub)
            sub_start = tail_slots[sub_at]
            sub_size = np.diff(np.append(sub_at, len(target)))
            left = gs + size[gs] > gs + moved
            size[gs[left]] -= moved[left]
            begin[tail[left]] = gs[left]
            size[sub_start] = sub_size
            begin[sub_start + sub_size] = sub_start
            group[target] = np.repeat(sub_start, sub_size)
        top[live] = start
        live = live[start > floor[live]]
    # Second phase.
    out = np.full(total, -1, np.int64)
    fill = np.arange(total + 1)
    placed = guard.copy()
    mark = base + sizes + 1
    out[base + 1] = mark
    placed[mark] = True
    fill[base + 1] += 1
    live = np.arange(n_s)
    step = 1
    while True:
        live = live[step <= sizes[live] + 1]
        if not len(live):
            break
        j = out[base[live] + step] - 1
        while True:
            j = j[~placed[j]]
            if not len(j):
                break
            g = group[j]
            out[fill[g]] = j
            fill[g] += 1
            placed[j] = True
            j = prev[j]
        step += 1
    keep = np.ones(total, bool)
    keep[base] = keep[base + 1] = False
    got = out[keep]
    return got - 1 - 2 * of[got]
