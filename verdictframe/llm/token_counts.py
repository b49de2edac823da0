"""Token counts that follow edits.

A document is kept as a segment tree over its pre-token pieces: the leaves are blocks
of pieces, each inner node holds the characters and tokens below it. An edit descends to the
piece it touches, splits again from a few characters before it, and stops at the first
border of the old split behind it: from there the old pieces still hold, because the
pattern looks only to the right. Only the new pieces are encoded; the sums on the
paths above the touched blocks are updated.

``edited_token_counts`` defines: a null text is empty; a null or empty edit list changes
nothing; edits run in the order given, each against the text as the earlier ones left
it, with offsets in code points cut to the text; a null replacement deletes; a null start is 0, a null stop
equals the start. Repeated rows are counted each for itself. Added columns replace columns of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictframe.llm.byte_bpe import REMEMBERED, Encoder, encoder

#: Pieces in a leaf of the tree.
LEAF = 64
#: Characters before an edit that are split again; the pattern looks at most two past a piece.
CONTEXT = 4

ADDED = {"n_pieces": "long", "n_tokens": "long", "n_tokens_after": "long", "n_chars_after": "long",
         "n_reencoded": "long"}


class TokenTree:
    """Segment tree of (characters, tokens) over blocks of pieces."""

    def __init__(self, enc: Encoder, pieces: list[str]):
        self.enc = enc
        self.reencoded = 0
        counts: list[int] = []
        for k in range(0, len(pieces), REMEMBERED // 2):
            counts += self._counts(pieces[k : k + REMEMBERED // 2])
        self.pieces_first = len(pieces)
        self.blocks = [pieces[k : k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]
        self.cap = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.cap, 2), dtype=np.int64)
        if pieces:
            cuts = np.arange(0, len(pieces), LEAF)
            both = np.array([[len(p) for p in pieces], counts], dtype=np.int64)
            self.sums[self.cap : self.cap + len(cuts)] = np.add.reduceat(both, cuts, axis=1).T
        level = self.cap
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(axis=1)
            level //= 2

    def _counts(self, pieces: list[str]) -> list[int]:
        self.enc.learn(pieces)
        known = self.enc.known
        return [len(known[p]) >> 2 for p in pieces]

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def text(self) -> str:
        return "".join(p for block in self.blocks for p in block)

    def _find(self, offset: int) -> tuple[int, int, int]:
        """Block, piece in it and start of the piece that holds the character."""
        node, before = 1, 0
        while node < self.cap:
            node *= 2
            if before + self.sums[node, 0] <= offset:
                before += int(self.sums[node, 0])
                node += 1
        block = node - self.cap
        for at, piece in enumerate(self.blocks[block]):
            if before + len(piece) > offset:
                return block, at, before
            before += len(piece)
        return block, len(self.blocks[block]), before

    def _update(self, block: int, counts: int) -> None:
        node = self.cap + block
        self.sums[node] = sum(map(len, self.blocks[block])), counts
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def replace(self, start: int, stop: int, new: str) -> None:
        size = self.chars
        start = min(max(start, 0), size)
        stop = min(max(stop, start), size)
        if not size:
            first, at, origin = 0, 0, 0
        else:
            first, at, origin = self._find(min(max(start - CONTEXT, 0), size - 1))
        shift = len(new) - (stop - start)
        block, piece, border = first, at, origin  # next old piece and where it starts
        buffer, borders = "", {}

        def take() -> bool:
            nonlocal block, piece, border, buffer
            while block < len(self.blocks) and piece >= len(self.blocks[block]):
                block, piece = block + 1, 0
            if block == len(self.blocks):
                return False
            buffer += self.blocks[block][piece]
            border += len(self.blocks[block][piece])
            piece += 1
            return True

        def mark() -> None:
            if border >= stop:
                borders[border - origin + shift] = (block, piece)

        while border < stop and take():
            pass
        buffer = buffer[: start - origin] + new + buffer[stop - origin :]
        if border < start:  # an edit right at the end of the touched piece
            while border < start and take():
                pass
        mark()
        pieces, pos = [], 0
        while True:
            if pos in borders and pos > 0:
                break
            found = self.enc.match(buffer, pos) if pos < len(buffer) else None
            if (found is None or found.end() + CONTEXT > len(buffer)) and take():
                mark()
                continue
            if found is None:
                break
            pieces.append(found.group())
            pos = found.end()
        last, rest = borders.get(pos, (len(self.blocks) - 1, len(self.blocks[-1])))
        self.reencoded += len(pieces)
        tail = self.blocks[last][rest:] if last < len(self.blocks) else []
        head = self.blocks[first][:at]
        if last == first:
            self.blocks[first] = head + pieces + tail
        else:
            self.blocks[first] = head + pieces
            for k in range(first + 1, min(last, len(self.blocks))):
                self.blocks[k] = []
            if last < len(self.blocks):
                self.blocks[last] = tail
        for k in range(first, min(last, len(self.blocks) - 1) + 1):
            if k in (first, last) or self.sums[self.cap + k].any():
                self._update(k, sum(self._counts(self.blocks[k])))


def edits_column(*edits: tuple[Column, Column, Column]) -> Column:
    """An edit list from (start, stop, replacement) columns."""
    return F.array(*[
        F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), c.cast("string").alias("text"))
        for a, b, c in edits
    ])


def edited_token_counts(
    docs: DataFrame, edits: Column, text: str = "text", vocabulary: str | None = None, pattern: str | None = None,
    keep: list[str] | None = None, edited: bool = False,
) -> DataFrame:
    """Token counts before and after the edits of each row, and how many pieces were encoded again.

    ``edits``: array of struct<start, stop, text>. ``edited`` adds the new text.
    """
    added = list(ADDED) + ["edited_text"] * edited
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    fields = {f.name: f for f in docs.schema.fields}
    work = docs.select(
        *[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], docs[text].alias("_text"), edits.alias("_edits")
    )
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            made: list[list] = [[] for _ in added]
            texts = [t or "" for t in batch.column(n).to_pylist()]
            changes = iter(batch.column(n + 1))
            for held in enc.split_all(texts):
                wanted = set().union(*held)
                if len(wanted) <= REMEMBERED // 2:  # the pieces of many texts are solved together
                    enc.learn(wanted)
                for pieces in held:
                    tree = TokenTree(enc, pieces)
                    before = tree.tokens
                    for e in next(changes).as_py() or []:
                        if e is not None:
                            start = e["start"] or 0
                            tree.replace(start, start if e["stop"] is None else e["stop"], e["text"] or "")
                    row = [tree.pieces_first, before, tree.tokens, tree.chars, tree.reencoded]
                    for values, x in zip(made, row + [tree.text()] * edited):
                        values.append(x)
            columns = [batch.column(i) for i in range(n)]
            columns += [pa.array(v, type=pa.string() if c == "edited_text" else pa.int64()) for c, v in zip(added, made)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    schema = T.StructType([fields[c] for c in keep])
    for c in added:
        schema = schema.add(c, ADDED.get(c, "string"))
    return work.mapInArrow(run, schema)
