"""Fill-in-the-middle: texts cut at two token borders and put together anew.

A text's tokens are its runs of ASCII letters and its other single characters. The code point
offsets at which a token ends form a ``BoundarySet``: chunks of 65,536 offsets, each kept as the
smallest of a sorted array, a bitmap or runs, with the number of borders before every
chunk. The offset of the k-th border is found by a search over those totals and a select
inside one chunk; both cuts of a text come from its set. Borders are 1 byte of mask per
character while a set is built, a run or an eighth of that afterwards.

The draws come from the sha256 of ``salt:id`` alone, so every run and every cluster cuts
alike. A text that holds a marker stays plain, hence ``restored`` gets every text back.

Row-local: no shuffle, a lost executor repeats its own partitions. Defined results: null and
empty texts are plain with 0 tokens and an empty output; a null id counts as an empty string
in the draw; repeated rows give repeated results; texts of any length are cut whole; kept columns that
have the name of an added one give way; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are cut, and of 100 cut ones so many put the suffix first.
CUT, SUFFIX_FIRST = 90, 20
CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS

_ONES = np.array([bin(b).count("1") for b in range(256)], dtype=np.int64)


class ArrayChunk:
    """Sorted members, two bytes each."""

    def __init__(self, members: np.ndarray):
        self.members = members.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.members[k])


class BitmapChunk:
    """One bit per possible member."""

    def __init__(self, members: np.ndarray):
        mask = np.zeros(CHUNK, dtype=bool)
        mask[members] = True
        self.bits = np.packbits(mask, bitorder="little")

    def select(self, k: int) -> int:
        until = np.cumsum(_ONES[self.bits])
        byte = int(np.searchsorted(until, k, side="right"))
        left = k - (int(until[byte - 1]) if byte else 0)
        return 8 * byte + int(np.flatnonzero(np.unpackbits(self.bits[byte : byte + 1], bitorder="little"))[left])


class RunChunk:
    """First members of runs and the number of members before each run."""

    def __init__(self, members: np.ndarray, heads: np.ndarray):
        self.starts = members[heads].astype(np.uint16)
        self.before = heads.astype(np.int32)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def chunk_of(members: np.ndarray):
    """The smallest container of sorted members below ``CHUNK``."""
    heads = np.flatnonzero(np.diff(members, prepend=-2) != 1)
    if 6 * len(heads) < min(2 * len(members), CHUNK // 8):
        return RunChunk(members, heads)
    return ArrayChunk(members) if 2 * len(members) <= CHUNK // 8 else BitmapChunk(members)


class BoundarySet:
    """A set of offsets with rank-to-offset lookup, from a mask over the offsets."""

    def __init__(self, mask: np.ndarray):
        self.keys, self.chunks, sizes = [], [], []
        for first in range(0, len(mask), CHUNK):
            members = np.flatnonzero(mask[first : first + CHUNK])
            if len(members):
                self.keys.append(first)
                self.chunks.append(chunk_of(members))
                sizes.append(len(members))
        self.until = np.cumsum(np.array(sizes, dtype=np.int64))

    def __len__(self) -> int:
        return int(self.until[-1]) if len(self.until) else 0

    def select(self, k: int) -> int:
        """The k-th smallest member, from 0."""
        chunk = int(np.searchsorted(self.until, k, side="right"))
        return self.keys[chunk] + self.chunks[chunk].select(k - (int(self.until[chunk - 1]) if chunk else 0))


def token_ends(text: str) -> np.ndarray:
    """Mask over offsets 0 .. len - 1: a token's last character stands there."""
    if text.isascii():
        codes = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letter = ((codes >= 65) & (codes <= 90)) | ((codes >= 97) & (codes <= 122))
    ends = np.ones(len(codes), dtype=bool)
    ends[:-1] = ~(letter[:-1] & letter[1:])
    return ends


def draws(key: str, salt: str = "1") -> list[int]:
    digest = hashlib.sha256(f"{salt}:{key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def cut(text: str, key: str) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, characters of the prefix, of the middle, output)."""
    borders = BoundarySet(token_ends(text))
    n = len(borders)
    h1, h2, h3, h4 = draws(key)
    if not n or h3 % 100 >= CUT or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (borders.select(k - 1) + 1 if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


ADDED = ["n", "form", "prefix_chars", "middle_chars", "output"]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n (tokens), form (plain, psm, spm), prefix_chars, middle_chars and output; ``keep``: columns to carry along, all by default."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    fields = {f.name: f for f in docs.schema.fields}
    work = docs.select(
        *[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], docs[text].alias("_text"),
        F.coalesce(docs[key].cast("string"), F.lit("")).alias("_id"),
    )
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(len(keep)), batch.column(len(keep) + 1)
            made = [cut(t.as_py() or "", i.as_py()) for t, i in zip(texts, ids)]
            added = [pa.array([m[c] for m in made], type=kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *added], names=[*keep, *ADDED])

    schema = T.StructType([fields[c] for c in keep])
    for name, kind in zip(ADDED, ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)
    return work.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text behind an output. Texts that were cut hold no marker, so each first marker is a true one."""

    def between(after: str, before: str | None = None) -> Column:
        start = F.locate(after, output) + len(after)
        stop = F.locate(before, output) if before else F.length(output) + 1
        return F.substring(output, start, stop - start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
