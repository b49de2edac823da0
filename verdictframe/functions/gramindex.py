"""Inverted lists over texts with upper bounds on the matching characters of ``charsim``.

Two kinds of lists are kept. Per character: the texts that hold it and how often; shared characters
bound every match. Per gram around a character that may begin a block, of texts of ``LONG`` characters: the places where
it stands. Every matching block holds such a place, apart from one block of equal first characters. How far
a block can reach to each side of it is told by the longest gram there that the other text holds, too.
The union of these reaches bounds the match of a long text, far better than shared characters do.

A search reads the lists of its own grams and nothing else. Grams are kept by 64-bit hashes; equal
hashes of different grams only raise a bound. Lengths are those of ``GRID``; between two of them a
reach counts as the longer one less one character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

from verdictframe.functions import charsim

GRID = (1, 2, 3, 4, 5, 6, 8, 10, 14, 20, 32, 64, 128)
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of all grams of some characters."""

    def __init__(self, codes: np.ndarray):
        n = len(codes) + 1
        with np.errstate(over="ignore"):
            up, down = np.full(n, _BASE, dtype=np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            self.sums = np.zeros(n, dtype=np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[starts + size] - self.sums[starts]) * self.down[starts] + np.uint64(size))


class Lists:
    """Members by key, each key's members in a row."""

    def __init__(self, keys: np.ndarray, members: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.members = members[order]

    def read(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the key, place of its member) of all members of the keys."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        hit = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else np.zeros(0, dtype=np.int64)
        at = at[hit]
        one, place = charsim._expanded(self.first[at], self.first[at + 1] - self.first[at])
        return hit[one], place


class GramIndex:
    """The lists of some texts."""

    def __init__(self, texts: list[str]):
        self.codes, self.bounds = charsim.codes_of(texts)
        self.size = np.diff(self.bounds)
        self.begin = charsim.beginners(self.codes, self.bounds)
        row = np.repeat(np.arange(len(texts)), self.size)
        pairs, count = np.unique(row * (1 << 32) + self.codes, return_counts=True)
        self.chars, self.char_count = Lists(pairs & 0xFFFFFFFF, pairs >> 32), None
        self.char_count = count[np.argsort(pairs & 0xFFFFFFFF, kind="stable")]
        long = self.size >= charsim.LONG
        self.long = long
        self.at = np.flatnonzero(self.begin & long[row])
        self.row = row[self.at]
        hashes = Hashes(self.codes)
        self.sides = []
        low, high = self.bounds[self.row], self.bounds[self.row + 1]
        for before in (False, True):
            keys, members = [], []
            for size in GRID[before:]:  # one character is the same to both sides
                start = self.at - size + 1 if before else self.at
                inside = np.flatnonzero((start >= low) & (start + size <= high))
                keys.append(hashes.of(start[inside], size))
                members.append(inside)
            self.sides.append(Lists(np.concatenate(keys), np.concatenate(members)))
        self.reads = 0

    def bounds_of(self, a: np.ndarray) -> np.ndarray:
        """Upper bounds on the matching characters of ``a`` with every text."""
        rows = len(self.size)
        chars, count = np.unique(a, return_counts=True)
        key, place = self.chars.read(chars.astype(np.int64))
        self.reads += len(place)
        shared = np.bincount(
            self.chars.members[place], weights=np.minimum(count[key], self.char_count[place]), minlength=rows
        ).astype(np.int64)
        if not len(self.at) or not len(a):
            return shared
        hashes = Hashes(a)
        grams = np.unique(np.concatenate([hashes.of(np.arange(len(a) - size + 1), size) for size in GRID if size <= len(a)]))
        reach = []
        for lists in self.sides:
            _, place = lists.read(grams)
            self.reads += len(place)
            reach.append(np.bincount(lists.members[place], minlength=len(self.at)))
        right, left = reach
        live = np.flatnonzero(right)
        most = np.append(np.array(GRID[1:]) - 1, 1 << 30)  # behind a hit of every length up to GRID[k]
        at, row = self.at[live], self.row[live]
        stop = np.minimum(at + most[np.minimum(right[live], len(GRID)) - 1], self.bounds[row + 1])
        start = np.maximum(at + 1 - most[np.minimum(left[live], len(GRID) - 1)], self.bounds[row])
        covered = np.bincount(row, weights=_covered(at, row, start, stop), minlength=rows).astype(np.int64)
        same = np.flatnonzero(self.long)
        begin = np.zeros(len(same), dtype=np.int64)
        covered[same] += charsim.common_prefix(a, begin, self.codes, self.bounds[same], np.minimum(self.size[same], len(a)))
        return np.where(self.long, np.minimum(shared, covered), shared)

    def matched(self, a: np.ndarray, a_bounds: np.ndarray, which: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Matching characters of texts ``which`` of ``a`` with the given rows, exactly."""
        _, place = charsim._expanded(self.bounds[rows], self.size[rows])
        bounds = np.concatenate([[0], np.cumsum(self.size[rows])])
        return charsim.matched(a, a_bounds, which, self.codes[place], bounds, self.begin[place])


def _covered(at: np.ndarray, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Per place (sorted) the characters that it adds to the union of [start, stop) around the places of its row."""
    if not len(at):
        return at
    # reaches never leave their row, so running bounds over all rows are right
    right = np.maximum.accumulate(stop)
    left = np.minimum.accumulate(start[::-1])[::-1]
    first = np.append(True, row[1:] != row[:-1])
    last = np.append(first[1:], True)
    out = 1 + np.where(first, at - left, 0)
    beyond = np.append(at[1:], 0)
    ahead = np.append(left[1:], 0)
    gap = np.minimum(beyond - at - 1, np.maximum(right - at - 1, 0) + np.maximum(beyond - ahead, 0))
    return out + np.where(last, np.maximum(right - at - 1, 0), gap)


#: Pairs of texts whose ratios are computed together.
PAIRS = 2_048
#: Texts tried first of all; the k-th best score among them spares most others.
FIRST_TRIED = 8


def likely_texts(
    index: GramIndex, a: np.ndarray, fixed: np.ndarray, factor: np.ndarray, order: np.ndarray, floor: float, at_most: int | None
) -> tuple[np.ndarray, np.ndarray]:
    """(texts, most that they can score) whose bound lets ``fixed + factor * ratio`` reach ``floor``, the most likely first, ``at_most`` of them."""
    reach = fixed + factor * (2.0 * index.bounds_of(a) / np.maximum(index.size + len(a), 1))
    likely = np.flatnonzero(reach >= floor - 1e-9)
    if at_most is not None and len(likely) > at_most:
        likely = likely[np.argpartition(-reach[likely], at_most)[:at_most]]
    likely = likely[np.lexsort((order[likely], -reach[likely]))]
    return likely, reach[likely]


def ratios_of(index: GramIndex, a: np.ndarray, bounds: np.ndarray, which: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Ratio of text ``which`` of ``a`` to a row, pair by pair."""
    out = np.zeros(len(rows))
    for first in range(0, len(rows), PAIRS):
        part = slice(first, first + PAIRS)
        whole = np.maximum(index.size[rows[part]] + np.diff(bounds)[which[part]], 1)
        out[part] = 2.0 * index.matched(a, bounds, which[part], rows[part]) / whole
    return out


def best_texts(
    index: GramIndex, texts: list[str], weights: Callable[[int], tuple[np.ndarray, np.ndarray, np.ndarray]], floors: list[float], k: int,
    at_most: int | None = None,
) -> Iterator[tuple[int, list[tuple[float, int, int]], int]]:
    """(number of the text, its k best (score, order, row) that reach its floor, ratios computed) for each of ``texts``.

    ``weights`` gives fixed, factor and order over the rows for a text: the score is fixed + factor * ratio, of equal
    ones the smaller order comes first. With ``at_most`` only so many rows are tried; better ones may be left.
    """
    a, bounds = charsim.codes_of(texts)
    held, size = [], 0
    for n in range(len(texts)):
        fixed, factor, order = weights(n)
        rows, reach = likely_texts(index, a[bounds[n] : bounds[n + 1]], fixed, factor, order, floors[n], at_most)
        held.append((n, floors[n], rows, reach, fixed[rows], factor[rows], order[rows]))
        size += len(rows)
        if size >= PAIRS or n == len(texts) - 1:
            yield from _tried(index, a, bounds, held, k)
            held, size = [], 0


def _tried(index: GramIndex, a: np.ndarray, bounds: np.ndarray, held: list[tuple], k: int) -> Iterator[tuple[int, list, int]]:
    numbers, _, rows, reach, fixed, factor, order = (list(c) for c in zip(*held))
    floors = [h[1] for h in held]
    scores = [np.zeros(0)] * len(held)
    for first, last in ((0, FIRST_TRIED), (FIRST_TRIED, None)):
        parts = []
        for h in range(len(held)):
            if first:
                if len(scores[h]) >= k:
                    floors[h] = max(floors[h], float(np.partition(scores[h], -k)[-k]))
                stop = int(np.searchsorted(-reach[h], -(floors[h] - 1e-9), side="right"))
                rows[h], fixed[h], factor[h], order[h] = (c[:stop] if stop > first else c[:first] for c in (rows[h], fixed[h], factor[h], order[h]))
            parts.append(rows[h][first:last])
        which = np.repeat(numbers, [len(p) for p in parts]).astype(np.int64)
        ratio = ratios_of(index, a, bounds, which, np.concatenate(parts))
        edges = np.cumsum([0] + [len(p) for p in parts])
        for h in range(len(held)):
            mine = ratio[edges[h] : edges[h + 1]]
            scores[h] = np.concatenate([scores[h], fixed[h][first : first + len(mine)] + factor[h][first : first + len(mine)] * mine])
    for h, n in enumerate(numbers):
        top = np.lexsort((order[h], -scores[h]))[:k]
        yield n, list(zip(scores[h][top].tolist(), order[h][top].tolist(), rows[h][top].tolist())), len(rows[h])
