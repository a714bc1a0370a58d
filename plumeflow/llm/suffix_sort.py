"""Suffix sorting by grouping, in linear time and without recursive renaming.

Phase 1 keeps the suffixes in groups, ordered by what is known of their Lyndon
prefixes, at first by their first symbols. Groups are processed from the
highest down. For each suffix of the group its previous smaller pointer is
found: the nearest suffix before it that is in a lower group. A suffix that is
pointed to continues with the group's prefix, as often as it is pointed to,
and so moves above those of its own group that are pointed to less often.
When all groups are processed, each holds the suffixes of one Lyndon prefix.

Phase 2 goes over the sorted order from the lowest suffix up. The suffix
before the one just reached, and those along its previous smaller pointers, are
each the next of their groups.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text) + 1
    # the end of the text counts as a symbol below all others
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    group, place, members, start_of = [0] * n, [0] * n, {}, {}
    at = 1
    members[0], start_of[1] = [n - 1], 0
    for c in sorted(by_symbol):
        own = by_symbol[c]
        members[at] = own
        for x, i in enumerate(own):
            group[i] = at
            place[i] = x
        start_of[at + len(own)] = at
        at += len(own)

    before = [-1] * n
    top = n
    while top > 1:
        start = start_of[top]
        pointed: dict[int, int] = {}
        own = members[start]
        own.sort()
        for s in own:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            touched: dict[int, dict[int, list[int]]] = {}
            for p, k in pointed.items():
                touched.setdefault(group[p], {}).setdefault(k, []).append(p)
            for g, levels in touched.items():
                whole = members[g]
                size = len(whole)
                for level in levels.values():
                    for i in level:  # out of its group, the last member takes its place
                        last = whole.pop()
                        if last != i:
                            whole[place[i]] = last
                            place[last] = place[i]
                at = g + len(whole)
                if whole:
                    start_of[at] = g
                for k in sorted(levels):
                    level = levels[k]
                    members[at] = level
                    for x, i in enumerate(level):
                        group[i] = at
                        place[i] = x
                    start_of[at + len(level)] = at
                    at += len(level)
                assert at == g + size
        top = start

    order, placed, front = [-1] * n, [False] * n, list(range(n))
    order[0] = n - 1
    placed[n - 1] = True
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[front[g]] = s
            front[g] += 1
            placed[s] = True
            s = before[s]
    return order[1:]
