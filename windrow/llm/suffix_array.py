"""Suffix array by linear grouping, without recursion or renaming.

The first phase groups suffixes by the Lyndon word that each begins with. All start in the group of their first
symbol, and groups are taken from the highest down. For every suffix of the group at hand, the nearest one before it
that stands in a lower group is found by previous-smaller pointers; the word of that one grows by the word of the
group, once for each suffix that points at it, and those of one old group that grow alike move to a new group right
above it. In the end the groups are in the order of their words.

A suffix is its Lyndon word followed by the next smaller suffix. So the second phase walks the array from its lowest
entry up and puts each suffix that is followed by the entry at the next free place of its group.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[tuple[int, list[int]]], list[int], list[int]]:
    """(group, its suffixes) from the highest group down, the group of each suffix, and the word length of each group."""
    first: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        if symbol in first:
            first[symbol].append(i)
        else:
            first[symbol] = [i]
    members = [first[symbol] for symbol in sorted(first)]
    size = [len(m) for m in members]
    word = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    group_of = [0] * len(text)
    for group, suffixes in enumerate(members):
        for i in suffixes:
            group_of[i] = group

    smaller = [-1] * len(text)
    passed = bytearray(len(text))
    done = []
    group = len(members) - 1
    while group >= 0:
        suffixes = members[group]
        if len(suffixes) != size[group]:
            suffixes = [i for i in suffixes if group_of[i] == group]
        suffixes.sort()
        done.append((group, suffixes))
        pointed: dict[int, int] = {}
        for i in suffixes:
            passed[i] = 1
            j = i - 1
            while j >= 0 and passed[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            key = (times, group_of[j])
            if key in moves:
                moves[key].append(j)
            else:
                moves[key] = [j]
        # More repeats of the word make a higher group, and each new group goes right above the old one.
        for (times, old), moved in sorted(moves.items(), key=lambda x: -x[0][0]) if len(moves) > 1 else moves.items():
            grown = word[old] + times * word[group]
            if len(moved) == size[old]:
                word[old] = grown
                members[old] = moved
                continue
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            word.append(grown)
            below.append(old)
            above.append(above[old])
            if above[old] >= 0:
                below[above[old]] = new
            above[old] = new
            size[old] -= len(moved)
            for j in moved:
                group_of[j] = new
        group = below[group]
    return done, group_of, word


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes in lexicographic order; a suffix that is a prefix of another one comes first."""
    n = len(text)
    done, group_of, word = lyndon_groups(text)
    free = [0] * len(word)
    place = 0
    followed_by: dict[int, list[int]] = {}
    for group, suffixes in reversed(done):
        free[group] = place
        place += len(suffixes)
        length = word[group]
        for i in suffixes:
            follower = i + length
            if follower in followed_by:
                followed_by[follower].append(i)
            else:
                followed_by[follower] = [i]
    array = [0] * n
    nothing: list[int] = []
    follower = n
    for place in range(n + 1):
        for i in followed_by.get(follower, nothing):
            group = group_of[i]
            array[free[group]] = i
            free[group] += 1
        if place < n:
            follower = array[place]
    return array
