"""Suffix arrays in linear time by grouping suffixes (no recursion, no renaming)."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of all suffixes of ``text`` (numbers from 0) in order.

    First suffixes with one first symbol are a group. Groups are processed from the highest
    down. For every suffix of a group the pointer to the previous smaller one is the nearest
    position before it whose group is lower. Of the positions pointed at, those with more
    suffixes of the group pointing at them are the greater ones, so they leave their own
    group for new ones just above it, ordered by that number. In the end a group holds the
    suffixes with one Lyndon prefix. Going through the order from the lowest suffix, the
    suffix before it and those along its pointers are the next ones of their groups.
    """
    n = len(text)
    symbols = sorted(set(text))
    number = {c: i + 1 for i, c in enumerate(symbols)}
    group = [number[c] for c in text]
    group.append(0)  # the empty suffix, below all
    members: list[list[int]] = [[] for _ in range(len(symbols) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    above = [*range(1, len(members)), -1]
    below = list(range(-1, len(members) - 1))
    open_ = [True] * len(members)
    previous = [-1] * (n + 1)
    now = len(members) - 1
    while now > 0:
        open_[now] = False  # from here on, closed groups are those not below this one
        pointed: dict[int, int] = {}
        own = [s for s in members[now] if group[s] == now]
        own.sort()
        for s in own:
            p = s - 1
            while p >= 0 and not open_[group[p]]:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            most = max(pointed.values())
            if most == 1:
                turns = [list(pointed)]
            else:
                by_count: dict[int, list[int]] = {}
                for p, k in pointed.items():
                    by_count.setdefault(k, []).append(p)
                turns = [by_count[k] for k in sorted(by_count, reverse=True)]
            for turn in turns:
                made: dict[int, int] = {}
                for p in turn:
                    g = group[p]
                    new = made.get(g)
                    if new is None:
                        new = made[g] = len(members)
                        members.append([])
                        open_.append(True)
                        up = above[g]
                        above.append(up)
                        below.append(g)
                        above[g] = new
                        below[up] = new  # the group left is below this one, so not the highest
                    group[p] = new
                    members[new].append(p)
        members[now] = own
        now = below[now]
    # Where each group begins in the order.
    order, slot, at, g = [0] * (n + 1), [0] * len(members), 0, 0
    size = [0] * len(members)
    for x in group:
        size[x] += 1
    while g >= 0:
        slot[g] = at
        at += size[g]
        g = above[g]
    placed = [False] * (n + 1)
    order[0] = n
    placed[n] = True
    for i in range(n + 1):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[slot[g]] = s
            slot[g] += 1
            placed[s] = True
            s = previous[s]
    return order[1:]
