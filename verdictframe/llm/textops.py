"""Vectorised text primitives on the UTF-8 bytes of an Arrow batch.

Hashes are 64-bit polynomials over the bytes (mod 2**64, odd base) followed by a
mixing step. Words never leave numpy, so a task handles tens of MB a second.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is cut behind a separator.
PIECE = 1 << 18

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


#: Separators of words: space, tab, line feed, vertical tab, form feed, return.
SPACES = table(b"\x20\x09\x0a\x0b\x0c\x0d")
LINE_END = table(b"\n")
#: Everything but ASCII letters and digits and the bytes of longer characters.
NOT_ALNUM = ~table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit mixing."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < size:
        base = _BASES[which]
        inverse = pow(base, -1, 1 << 64)
        size = max(size, PIECE + 1)
        up, down = np.full(size, base, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        have = _POWERS[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have


def ascii_lower(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << np.uint8(5))


def latin_lower(data: np.ndarray) -> np.ndarray:
    """ASCII and the Latin-1 capitals (two bytes, the first 0xC3) in lower case."""
    out = ascii_lower(data)
    if len(data) > 1:
        second = data[1:]
        capital = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        out[1:] += capital.astype(np.uint8) << np.uint8(5)
    return out


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    up, down = _powers(which, len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of other bytes; a run never crosses a bound."""
    inside = ~separators[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        first = bounds[:-1][bounds[:-1] < len(data)]
        before[first] = False
        last = bounds[1:][bounds[1:] > 0] - 1
        after[last] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its rows; null counts as empty."""
    values = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(values.type):
        values = values.cast(pa.large_string())
    values = values.fill_null("")
    _, offsets, data = values.buffers()
    if not len(values):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    bounds = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, dtype=np.uint8), bounds - bounds[0]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row stands alone."""
    first, rows = 0, len(bounds) - 1
    while first < rows:
        last = int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def pieces(data: np.ndarray, separators: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts one long text behind separators, so that no run is split."""
    start = 0
    while start < len(data):
        stop = min(start + PIECE, len(data))
        while stop < len(data):
            cut = np.flatnonzero(separators[data[start:stop]])
            if len(cut):
                stop = start + int(cut[-1]) + 1
                break
            stop = min(stop + PIECE, len(data))
        yield start, stop
        start = stop


def hashed_runs(
    data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, lower=None, which: int = 0
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per row range: (first row, last row, hashes of its runs, bounds of the rows in them)."""
    for first, last in chunks(bounds):
        part = data[bounds[first] : bounds[last]]
        rows = bounds[first : last + 1] - bounds[first]
        if lower is not None:
            part = lower(part)
        if len(part) <= 2 * PIECE:
            starts, ends = spans(part, rows, separators)
            yield first, last, hash_spans(part, starts, ends, which), np.searchsorted(starts, rows)
            continue
        found = []
        for a, b in pieces(part, separators):
            cut = part[a:b]
            starts, ends = spans(cut, np.array([0, len(cut)]), separators)
            found.append(hash_spans(cut, starts, ends, which))
        whole = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
        yield first, last, whole, np.array([0, len(whole)])


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of ``n`` following words, sorted; fewer words give one shingle, none gives none."""
    if not len(words):
        return words
    width = min(n, len(words))
    h = np.full(len(words) - width + 1, np.uint64(width), dtype=np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - width + 1 + k])
    return np.unique(h)
