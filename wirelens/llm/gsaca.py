"""Suffix arrays by linear grouping, for many texts side by side.

Every text is sorted on its own; numpy works on one group of each text at a
time. Phase one takes the groups of a text in descending order. For each
suffix of a group it finds the previous smaller one, the nearest to the left
in a lower group, by following the pointers of higher groups. Suffixes
pointed at leave their group for a new one just above it, further up the more
pointers they get. In the end suffixes with the same Lyndon prefix share a
group and the groups are in order. Phase two walks the suffix array from its
start and puts the suffixes that end their Lyndon prefix at the current one
at the front of their groups; nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for size[0] numbers, then start[1], ..."""
    ends = size.cumsum()
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def group(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase one. Text t is text[first[t]:first[t]+size[t]], ends with its one
    smallest letter, and leaves the place before it free. Returns every
    place's group (the first slot that the group fills) and previous smaller
    place (the free place: none)."""
    n = len(text)
    places = _ragged(first, size)
    owner = np.repeat(np.arange(len(first)), size)
    order = np.lexsort((text[places], owner))
    sa, slot_of = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sa[places] = places[order]
    slot_of[sa[places]] = places
    letter, of = text[sa[places]], owner
    new = np.ones(len(places), bool)
    new[1:] = (letter[1:] != letter[:-1]) | (of[1:] != of[:-1])
    heads = places[new]
    sizes = np.diff(np.append(np.flatnonzero(new), len(places)))
    member = np.full(n, -1, np.int64)
    member[sa[places]] = np.repeat(heads, sizes)
    end = np.zeros(n + 1, np.int64)
    end[heads] = heads + sizes
    before = np.full(n, -1, np.int64)
    flag = np.zeros(n, bool)
    low, high = first.copy(), first + size
    while len(high):
        start = member[sa[high - 1]]
        count = high - start
        at = sa[_ragged(start, count)]
        own = np.repeat(start, count)
        cur = at - 1
        live = np.flatnonzero(member[cur] > own)
        while len(live):
            cur[live] = before[cur[live]]
            live = live[member[cur[live]] > own[live]]
        before[at] = cur
        live = np.flatnonzero(member[cur] == own)
        while len(live):
            cur[live] = before[cur[live]]
            before[at[live]] = cur[live]
            live = live[member[cur[live]] == own[live]]
        high, low = start[start > low], low[start > low]
        p, times = np.unique(cur[member[cur] >= 0], return_counts=True)
        if not len(p):
            continue
        home = member[p]
        by = np.lexsort((times, home))
        p, times, home = p[by], times[by], home[by]
        lead = np.ones(len(p), bool)
        lead[1:] = home[1:] != home[:-1]
        sub = lead.copy()
        sub[1:] |= times[1:] != times[:-1]
        heads, moved = np.flatnonzero(lead), np.diff(np.append(np.flatnonzero(lead), len(p)))
        end[home[heads]] -= moved
        to = np.repeat(end[home[heads]] - heads, moved) + np.arange(len(p))
        came = slot_of[p]
        flag[to] = True
        vacant = np.sort(came[~flag[came]])
        flag[to] = False
        flag[came] = True
        pushed = np.sort(to[~flag[to]])
        flag[came] = False
        others = sa[pushed]
        sa[vacant], slot_of[others] = others, vacant
        sa[to], slot_of[p] = p, to
        heads = np.flatnonzero(sub)
        parts = np.diff(np.append(heads, len(p)))
        member[p] = np.repeat(to[heads], parts)
        end[to[heads]] = to[heads] + parts
    return member, before


def emit(member: np.ndarray, before: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Phase two: slots first[t]..first[t]+size[t]-1 hold the places of text t
    in the order of its suffixes."""
    sa = np.full(len(member), -1, np.int64)
    front = np.arange(len(member))
    placed = member < 0  # the free places end every chain
    last = first + size - 1
    sa[first] = last
    placed[last] = True
    longest = np.argsort(-size, kind="stable")
    slot, left = first[longest], size[longest]
    step = 0
    while len(slot):
        cur = sa[slot] - 1
        cur = cur[~placed[cur]]
        while len(cur):
            home = member[cur]
            sa[front[home]] = cur
            front[home] += 1
            placed[cur] = True
            cur = before[cur]
            cur = cur[~placed[cur]]
        step += 1
        n = np.searchsorted(-left, -step, "left")  # texts of more letters than that
        slot, left = slot[:n] + 1, left[:n]
    return sa


def suffix_arrays(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return emit(*group(text, first, size), first, size)
