"""Suffix array of a string by linear grouping: Lyndon-prefix groups in descending order, then their order is emitted.

Phase 1 starts with a group per first symbol. Groups are taken in descending order; each member's pointer goes to the nearest
earlier suffix of a lower group, found by following the pointers of what is already done. The suffixes pointed to leave
their group for new ones right above it, those with more pointers higher; a group that moves as a whole stays where it is. In the end a group
holds the suffixes with one longest Lyndon prefix. Members of a group stand in text order, and so do the suffixes that they point to (between a
member and what it points to nothing is lower), so equal pointers are neighbours and nothing is sorted. Phase 2 goes up the array once: from each
suffix placed, the pointers lead to those that come next in their own groups. Nothing is renamed and nothing recurses.

A search for a pointer passes at most the suffixes between the two. Where the string consists of parts of bounded length, each ended by
the least symbol, no search leaves its part, so the time is linear in the string's length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(s: Sequence[int]) -> list[int]:
    """Starts of the suffixes of s (symbols from 0) in order; a proper prefix comes first."""
    n = len(s)
    if not n:
        return []
    symbols = np.frombuffer(s, dtype=np.uint8) if isinstance(s, bytes) else np.asarray(s)
    order = np.argsort(symbols, kind="stable")
    cuts = np.flatnonzero(np.diff(symbols[order])) + 1
    members = [x.tolist() for x in np.split(order, cuts)]  # by group number, in text order
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))  # the next lower group
    above = [*range(1, len(members)), -1]
    number = np.empty(n, dtype=np.int64)
    number[order] = np.repeat(np.arange(len(members)), size)
    group = number.tolist()
    prev = [-2] * (n + 1)  # -2: not done; the last stands for what is before the text
    now = len(members) - 1
    while now >= 0:
        own = members[now]
        if size[now] != len(own):
            own = [i for i in own if group[i] == now]
        members[now] = None
        last, count = -1, 0
        runs: list[tuple[int, int]] = []
        for i in own:
            j = i - 1
            while (q := prev[j]) != -2:
                j = q
            prev[i] = j
            if j == last:
                count += 1
            else:
                if last >= 0:
                    runs.append((last, count))
                last, count = j, 1
        if last >= 0:
            runs.append((last, count))
        if len(runs) == 1:
            j = runs[0][0]
            if size[group[j]] > 1:
                _split(runs, members, size, below, above, group)
        elif runs:
            _split(runs, members, size, below, above, group)
        now = below[now]
    first, g, at = [0] * len(size), 0, 0
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        first[g] = at
        at += size[g]
        g = above[g]
    out, todo = [-1] * n, [True] * n
    j = n - 1
    while j >= 0 and todo[j]:
        g = group[j]
        out[first[g]] = j
        todo[j] = False
        first[g] += 1
        j = prev[j]
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and todo[j]:
            g = group[j]
            out[first[g]] = j
            todo[j] = False
            first[g] += 1
            j = prev[j]
    return out


def _split(runs: list[tuple[int, int]], members: list, size: list[int], below: list[int], above: list[int], group: list[int]) -> None:
    """Move the suffixes pointed to, given with the number of pointers, right above what is left of their groups."""
    moved: dict[tuple[int, int], list[int]] = {}
    for j, count in runs:
        key = (count, group[j])
        if key in moved:
            moved[key].append(j)
        else:
            moved[key] = [j]
    for key in sorted(moved, reverse=True) if len(moved) > 1 else moved:
        own, old = moved[key], key[1]
        if len(own) == size[old]:
            continue  # what is above it has left before, and nothing stays below
        g = len(members)
        members.append(own)
        size.append(len(own))
        size[old] -= len(own)
        up = above[old]
        below.append(old)
        above.append(up)
        above[old] = g
        if up >= 0:
            below[up] = g
        for j in own:
            group[j] = g


def common_prefixes(s: bytes, order: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in order with the one before (0 for the first)."""
    n, h = len(order), 0
    rank, out = [0] * n, [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out
