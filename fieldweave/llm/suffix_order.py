"""Linear-time suffix sorting by grouping: no recursion, no renaming.

Every suffix has a longest Lyndon prefix, which ends where the next smaller suffix begins. Phase one groups suffixes by that
prefix: groups go from the largest to the smallest, and each suffix of a group extends the prefix of the nearest earlier suffix of a lower
group (its previous smaller suffix), which moves to the upper end of its group. Phase two reads suffixes in ascending order and puts every
suffix that ends its Lyndon prefix at the one just read into the next place of its group.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> list[int]:
    """Starts of the suffixes of ``symbols`` in ascending order. The last symbol must be smaller than all others."""
    n = len(symbols)
    first = np.argsort(symbols, kind="stable")
    ordered = symbols[first]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[starts, n])
    of_suffix = np.empty(n, np.int64)
    of_suffix[first] = np.repeat(starts, sizes)
    places = np.empty(n, np.int64)
    places[first] = np.arange(n)
    order, place, group = first.tolist(), places.tolist(), of_suffix.tolist()
    last = {s: s + z - 1 for s, z in zip(starts.tolist(), sizes.tolist(), strict=True)}
    lower = [-1] * n
    end = n - 1
    while end >= 0:
        start = group[order[end]]
        if start == end:  # one suffix: at most one moves, to the end of its group
            suffix = order[end]
            end -= 1
            before = suffix - 1
            while before >= 0 and group[before] >= start:
                before = lower[before]
            lower[suffix] = before
            if before >= 0:
                own = group[before]
                to = last[own]
                if own != to:
                    at = place[before]
                    if at != to:
                        other = order[to]
                        order[at] = other
                        place[other] = at
                        order[to] = before
                        place[before] = to
                    last[own] = to - 1
                    last[to] = to
                    group[before] = to
            continue
        members = order[start:end + 1]
        members.sort()
        met: dict[int, int] = {}
        for suffix in members:
            before = suffix - 1
            while before >= 0 and group[before] >= start:
                before = lower[before]
            lower[suffix] = before
            if before >= 0:
                met[before] = met.get(before, 0) + 1
        # More repeats of this group's prefix make a larger prefix: the most repeats go to the very end.
        if met:
            most = max(met.values())
            if most == 1:
                classes = [list(met)]
            else:
                by_repeats: dict[int, list[int]] = {}
                for suffix, repeats in met.items():
                    by_repeats.setdefault(repeats, []).append(suffix)
                classes = [by_repeats[k] for k in sorted(by_repeats, reverse=True)]
            for moving in classes:
                ends: dict[int, int] = {}
                for suffix in moving:
                    own = group[suffix]
                    to = last[own]
                    if own not in ends:
                        ends[own] = to
                    at = place[suffix]
                    if at != to:
                        other = order[to]
                        order[at], order[to] = other, suffix
                        place[other], place[suffix] = at, to
                    last[own] = to - 1
                for own, top in ends.items():
                    cut = last[own] + 1
                    last[cut] = top
                    if cut != own:
                        for at in range(cut, top + 1):
                            group[order[at]] = cut
        end = start - 1
    # Phase two. The last symbol is the smallest suffix.
    slot = group  # the next free place of a group is kept at its first place
    free = list(range(n))
    placed = bytearray(n)
    out = [0] * n
    out[0] = n - 1
    placed[n - 1] = 1
    for rank in range(n):
        suffix = out[rank] - 1
        while suffix >= 0 and not placed[suffix]:
            own = slot[suffix]
            out[free[own]] = suffix
            free[own] += 1
            placed[suffix] = 1
            suffix = lower[suffix]
    return out
