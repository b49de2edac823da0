"""Matching characters of two texts, as ratio of longest matching blocks.

The ratio of a text ``a`` to a text ``b`` is 2 M / (len a + len b). M counts the characters of the longest common
block, then, to the left and to the right of it, of the longest one there, and so on. Of equally long blocks the first one in ``a``
counts, then the first one in ``b``. In a ``b`` of ``LONG`` characters or more, characters that occur
more than 1 % + 1 times are popular: they lengthen a block but do not begin one.

``matched`` works on many pairs at once. Equal characters that may begin a block form runs along
diagonals (place in b minus place in a); every step takes the longest run of each open range, clipped to it, lengthens it by the equal
characters around it, and cuts the range in two.
"""

from __future__ import annotations

import numpy as np

LONG = 200


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and where each text begins."""
    joined = "".join(texts)
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), bounds


def beginners(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mask over the characters of all texts: those that may begin a block."""
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(size)), size)
    _, back, count = np.unique(row * (1 << 32) + codes, return_inverse=True, return_counts=True)
    return (size[row] < LONG) | (count[back] <= size[row] // 100 + 1)


def _expanded(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the group, member) of groups of ``count`` numbers from ``first`` on."""
    group = np.repeat(np.arange(len(count)), count)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _runs(
    a: np.ndarray, a_bounds: np.ndarray, which: np.ndarray, b: np.ndarray, bounds: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, ...]:
    """Runs (row, diagonal, start and end in a) of equal characters, ``at`` being the places in b that may begin one."""
    text = np.repeat(np.arange(len(a_bounds) - 1), np.diff(a_bounds))
    keys = text * (1 << 32) + a
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    row = np.searchsorted(bounds, at, side="right") - 1
    wanted = which[row] * (1 << 32) + b[at]
    lo, hi = np.searchsorted(ordered, wanted), np.searchsorted(ordered, wanted, side="right")
    one, place = _expanded(lo, hi - lo)
    row = row[one]
    i = order[place] - a_bounds[which[row]]
    d = at[one] - bounds[row] - i
    # sorted by row, diagonal, place in a: packed into one number
    width = int(np.diff(a_bounds).max(initial=0)) + 1
    spread = int(np.diff(bounds).max(initial=0)) + width
    key = np.sort((row * spread + d + width - 1) * width + i)
    rest, i = np.divmod(key, width)
    head = np.flatnonzero(np.diff(key, prepend=key[:1] - 2) != 1)
    # a place in a never reaches width - 1, so neighbours in the key are neighbours on a diagonal
    row, d = np.divmod(rest[head], spread)
    last = np.append(head[1:], len(key))[: len(head)] - 1
    return row, d - (width - 1), i[head], i[last] + 1


def _first_of_each(at: np.ndarray, length: np.ndarray, start: np.ndarray, d: np.ndarray, width: int) -> np.ndarray:
    """Per range the longest run, of equal ones the first in a, then in b."""
    if len(at) and (int(at.max()) + 1) * 2 * width**3 < 1 << 62:  # packed into one number
        order = np.argsort(((at * width + width - 1 - length) * width + start) * (2 * width) + d + width)
    else:
        order = np.lexsort((d, start, -length, at))
    return order[np.flatnonzero(np.diff(at[order], prepend=-1))]


def matched(
    a: np.ndarray, a_bounds: np.ndarray, which: np.ndarray, b: np.ndarray, bounds: np.ndarray, begin: np.ndarray
) -> np.ndarray:
    """Matching characters of text ``which[row]`` of ``a`` with each text (row) of ``b``; ``begin`` is the mask of ``beginners``."""
    rows = len(bounds) - 1
    found = np.zeros(rows, dtype=np.int64)
    size, base = np.diff(bounds), a_bounds[which]
    na = np.diff(a_bounds)[which]
    if not len(a) or not len(b):
        return found
    row, d, s, e = _runs(a, a_bounds, which, b, bounds, np.flatnonzero(begin))
    es, ee = s.copy(), e.copy()
    for side in (-1, 1):  # equal characters around a run
        live = np.arange(len(s))
        while len(live):
            i = es[live] - 1 if side < 0 else ee[live]
            j = i + d[live]
            inside = (i >= 0) & (i < na[row[live]]) & (j >= 0) & (j < size[row[live]])
            live, i, j = live[inside], i[inside], j[inside]
            same = a[base[row[live]] + i] == b[bounds[row[live]] + j]
            live = live[same]
            if side < 0:
                es[live] -= 1
            else:
                ee[live] += 1
    # open ranges: row, [alo, ahi) of a, [blo, bhi) of b; a run points to its range
    of = np.arange(rows)
    alo, ahi = np.zeros(rows, dtype=np.int64), na.copy()
    blo, bhi = np.zeros(rows, dtype=np.int64), size.copy()
    at, width = row, int(max(na.max(), size.max())) + 1
    while len(of):
        s1 = np.maximum(np.maximum(s, alo[at]), blo[at] - d)
        e1 = np.minimum(np.minimum(e, ahi[at]), bhi[at] - d)
        keep = np.flatnonzero(e1 > s1)
        s1, e1, at, d, s, e, es, ee = (c[keep] for c in (s1, e1, at, d, s, e, es, ee))
        best = _first_of_each(at, e1 - s1, s1, d, width)
        has = np.zeros(len(of), dtype=bool)
        has[at[best]] = True
        start = np.flatnonzero(~has & (alo == 0) & (blo == 0))  # nothing begins a block: equal first characters remain
        here = of[start]
        found[here] += common_prefix(a, base[here], b, bounds[here], np.minimum(ahi[start], bhi[start]))
        g = at[best]
        bs = np.maximum(np.maximum(es[best], alo[g]), blo[g] - d[best])
        be = np.minimum(np.minimum(ee[best], ahi[g]), bhi[g] - d[best])
        found += np.bincount(of[g], weights=be - bs, minlength=rows).astype(np.int64)
        # two ranges for each that had a block, left ones first; empty ones go with their runs
        place = np.full(len(of), -1)
        place[g] = np.arange(len(g))
        k = len(g)
        of, alo, ahi, blo, bhi = (
            np.concatenate([of[g], of[g]]), np.concatenate([alo[g], be]), np.concatenate([bs, ahi[g]]),
            np.concatenate([blo[g], be + d[best]]), np.concatenate([bs + d[best], bhi[g]]),
        )
        left = place[at]
        d, s, e, es, ee = (np.concatenate([c, c]) for c in (d, s, e, es, ee))
        at = np.concatenate([left, left + k])
        real = (alo < ahi) & (blo < bhi)
        renamed = np.cumsum(real) - 1
        keep = np.flatnonzero(real[at]) if len(at) else np.zeros(0, dtype=np.int64)
        at, d, s, e, es, ee = renamed[at[keep]], d[keep], s[keep], e[keep], es[keep], ee[keep]
        of, alo, ahi, blo, bhi = of[real], alo[real], ahi[real], blo[real], bhi[real]
    return found


def common_prefix(a: np.ndarray, a_first: np.ndarray, b: np.ndarray, b_first: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal characters from places in ``a`` and in ``b`` on, ``most`` at the most."""
    out = np.zeros(len(most), dtype=np.int64)
    live, k = np.flatnonzero(most > 0), 0
    while len(live):
        live = live[a[a_first[live] + k] == b[b_first[live] + k]]
        k += 1
        out[live] = k
        live = live[most[live] > k]
    return out


def shared(a: np.ndarray, a_bounds: np.ndarray, which: np.ndarray, b: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Characters that text ``which[row]`` of ``a`` shares with each text (row) of ``b``, repeats included: never fewer than match."""
    def counted(codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        return np.unique(text * (1 << 32) + codes, return_counts=True)

    own, mine = counted(a, a_bounds)
    pairs, count = counted(b, bounds)
    if not len(own) or not len(pairs):
        return np.zeros(len(which), dtype=np.int64)
    wanted = which[pairs >> 32] * (1 << 32) + (pairs & 0xFFFFFFFF)
    at = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
    both = np.where(own[at] == wanted, np.minimum(mine[at], count), 0)
    return np.bincount(pairs >> 32, weights=both, minlength=len(which)).astype(np.int64)


def ratios(text: str, others: list[str]) -> np.ndarray:
    """The ratio of ``text`` to each other text; 0 where one of the two is empty."""
    a, a_bounds = codes_of([text])
    b, bounds = codes_of(others)
    found = matched(a, a_bounds, np.zeros(len(others), dtype=np.int64), b, bounds, beginners(b, bounds))
    return 2.0 * found / np.maximum(len(a) + np.diff(bounds), 1)
