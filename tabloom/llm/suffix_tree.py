"""Common-prefix interval tree of an enhanced suffix array, by a stack scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of every interval of suffixes that share ``depth`` > 0 leading characters and no more.

    ``lcp[i]`` is what suffixes i and i + 1 of the sorted array share. Children come before their parents.
    """
    stack: list[tuple[int, int]] = []  # depth, first
    for i, shared in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > shared:
            depth, first = stack.pop()
            yield first, i, depth
        if shared and (not stack or stack[-1][0] < shared):
            stack.append((shared, first))


def shared_between(lcp: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What neighbours in ``places`` (rising indices of the sorted array) share: minima of ``lcp`` between them."""
    return np.minimum.reduceat(lcp[: places[-1]], places[:-1])


def maximal_repeats(
    lcp: np.ndarray, left_place: np.ndarray, left_lcp: np.ndarray, least: int
) -> Iterator[tuple[np.ndarray, int, int]]:
    """(members, left, right): maximal repeats of occurrences that meet in one anchor, at least ``least`` long.

    The occurrences are sorted by what follows the anchor's start, neighbours sharing ``lcp``; ``left_place`` is their
    place in the order by what precedes it, read backward, whose neighbours share ``left_lcp``. An interval of the
    first order that can't be extended to the right is split by the intervals of the second: members that share
    ``left`` characters before the anchor and differ in the next one, or have none. What only repeats a deeper
    interval is left out. Members are indices of the first order, all that hold the repeat.
    """
    at_place = np.argsort(left_place)
    for first, last, right in intervals(lcp.tolist()):
        places = np.sort(left_place[first : last + 1])
        between = shared_between(left_lcp, places)
        whole = int(between.min())
        found = [(0, len(places) - 1, whole)] if whole + right >= least else []
        if int(between.max()) > whole:
            found += [x for x in intervals(between.tolist()) if x[2] > whole]
        for a, b, left in found:
            if left + right >= least:
                members = np.sort(at_place[places[a : b + 1]])
                if lcp[members[0] : members[-1]].min() == right:
                    yield members, left, right
