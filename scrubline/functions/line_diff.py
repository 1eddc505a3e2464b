"""Patience alignment of two lists of lines.

Lines found once on each side are anchors; the longest run of anchors in the same order is
kept and the stretches between them are aligned in turn. Where no line is unique, a line and
the number of its occurrence stand for a unique one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, ordered by their first place, that rises in the second."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            ends.append(k)
        else:
            tails[at], ends[at] = j, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _numbered(lines: Sequence[Hashable]) -> Iterator[tuple[Hashable, int]]:
    seen: Counter = Counter()
    for line in lines:
        seen[line] += 1
        yield line, seen[line]


def _anchors(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Pairs of equal lines, rising on both sides."""
    left, right = Counter(a), Counter(b)
    place = {x: j for j, x in enumerate(b) if right[x] == 1}
    pairs = [(i, place[x]) for i, x in enumerate(a) if left[x] == 1 and x in place]
    if not pairs:
        place = {x: j for j, x in enumerate(_numbered(b))}
        pairs = [(i, place[x]) for i, x in enumerate(_numbered(a)) if x in place]
    return _rising(pairs)


def aligned(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[tuple[int, int]]:
    """Places ``(i, j)`` of lines kept from ``a`` to ``b``, rising on both sides."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, m, j, n = open_.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        found = [(x + i, y + j) for x, y in _anchors(a[i:m], b[j:n])]
        out += found
        if found:
            for x, y in [*found, (m, n)]:
                open_.append((i, x, j, y))
                i, j = x + 1, y + 1
    return sorted(out)


def line_diff_script(a: Sequence[str], b: Sequence[str]) -> Iterator[tuple[str, str, int | None, int | None]]:
    """``(status, line, place before, place after)``, places from 1. Between two kept lines
    what was removed comes before what was added."""
    i = j = 0
    for x, y in [*aligned(a, b), (len(a), len(b))]:
        for k in range(i, x):
            yield "removed", a[k], k + 1, None
        for k in range(j, y):
            yield "added", b[k], None, k + 1
        if x < len(a):
            yield "same", a[x], x + 1, y + 1
        i, j = x + 1, y + 1
