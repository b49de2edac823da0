"""Byte-level BPE by prefix dynamic programming.

Every prefix of a byte string has one valid last token: the token that ends there
and may stand behind the valid last token of the prefix it leaves. A table of these
tokens holds the encoding of all prefixes at once, so bytes can be appended without
looking back, and after an edit only the entries from the edit on are computed again.
Two tokens may follow one another if no merge across their border comes before the
merges that made them; that is what the rank order of byte-pair merging decides.

A text is first split by the pre-token pattern, and each piece is encoded alone.
Pieces of a batch are solved together, position by position, in numpy.

``encode_documents`` defines: null text is empty; an empty text has no tokens;
repeated rows are encoded each for itself; other columns are kept. A text of any
length is encoded whole. The pieces of a text are held in memory, one text at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Longest piece solved in numpy; longer ones take the scalar table.
WIDE = 40
#: Fewer new pieces than this take the scalar table too.
FEW = 200
#: Pieces solved together in numpy.
SOLVED = 8_192
#: Slots, as a power of two, of the table of checked token pairs.
SEEN_BITS = 20
#: Pieces a task remembers before it forgets them all, some 200 bytes each.
REMEMBERED = 250_000
#: Characters of text split and encoded at once.
AT_ONCE = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class KeyTable:
    """Open-addressed table from 64-bit keys to small numbers, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys) * 8).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)
        at = self._home(keys)
        todo = np.arange(len(keys))
        while len(todo):
            spots = at[todo]
            _, one = np.unique(spots, return_index=True)
            one = one[self.values[spots[one]] < 0]
            self.keys[spots[one]] = keys[todo[one]]
            self.values[spots[one]] = values[todo[one]]
            todo = np.delete(todo, one)
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        out = self.values[at]
        wrong = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.mask
            out[wrong] = self.values[at[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[at[wrong]] != keys[wrong])]
        return out


class Vocabulary:
    """Ranks of a ``.tiktoken`` file with the merge that makes each token."""

    base = 0x9DDFEA08EB382D69

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.left, self.right = list(range(size)), list(range(size))
        self.made: dict[int, int] = {}
        reachable = []
        for rank, token in enumerate(self.tokens):
            if len(token) == 1 or self._split(rank, token):
                reachable.append(rank)
        self.by_bytes = {self.tokens[r]: r for r in reachable}
        self.longest = max(map(len, self.by_bytes))
        self.lengths: list[list[int]] = [[] for _ in range(256)]
        for end in range(256):
            self.lengths[end] = sorted({len(t) for t in self.by_bytes if t[-1] == end})
        self._arrays(reachable)

    def _split(self, rank: int, token: bytes) -> bool:
        for cut in range(1, len(token)):
            a, b = self.ranks.get(token[:cut], rank), self.ranks.get(token[cut:], rank)
            if a < rank and b < rank and self.follows(a, b):
                self.left[rank], self.right[rank] = a, b
                self.made[a << 32 | b] = rank
                return True
        return False

    def follows(self, a: int, b: int) -> bool:
        """Whether ``b`` may stand behind ``a``: undo their last merges from the border outwards."""
        made, left, right = self.made, self.left, self.right
        limit = 1 << 31
        while True:
            if made.get(a << 32 | b, limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def _arrays(self, reachable: list[int]) -> None:
        self.left_a, self.right_a = np.array(self.left, dtype=np.int64), np.array(self.right, dtype=np.int64)
        keys = np.array([self.hash(self.tokens[r]) for r in reachable], dtype=np.uint64)
        self.table = KeyTable(keys, np.array(reachable, dtype=np.int32))
        made = list(self.made.items())
        self.merge = KeyTable(np.array([k for k, _ in made], dtype=np.uint64), np.array([v for _, v in made], dtype=np.int32))
        self.seen = np.full(1 << SEEN_BITS, (1 << 64) - 1, dtype=np.uint64)
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.powers = np.array([pow(self.base, k, 1 << 64) for k in range(WIDE + 1)], dtype=np.uint64)

    def hash(self, token: bytes) -> int:
        h = 0
        for b in token:
            h = (h * self.base + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def follow_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``follows`` for arrays of pairs; the answers of earlier pairs are kept in a table of fixed size."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
        stored = self.seen[at]
        new = np.flatnonzero((stored >> np.uint64(1)) != keys)
        if len(new):
            answer = self._follow_new(a[new].astype(np.int64), b[new].astype(np.int64))
            stored[new] = (keys[new] << np.uint64(1)) | answer
            self.seen[at[new]] = stored[new]
        return (stored & np.uint64(1)).astype(bool)

    def _follow_new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), dtype=bool)
        at = np.arange(len(a))
        limit = np.full(len(a), 1 << 31, dtype=np.int64)
        while len(at):
            m = self.merge.get((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
            keep = (m < 0) | (m >= limit)
            at, a, b, limit = at[keep], a[keep], b[keep], limit[keep]
            turn = a > b
            na, nb = self.right_a[a], self.left_a[b]
            a_end, b_end = na == a, nb == b
            done = a_end & b_end
            step_a = (turn & ~a_end) | (~turn & b_end)
            limit = np.where(step_a, a, b + 1)
            a, b = np.where(step_a, na, a), np.where(step_a, b, nb)
            out[at[done]] = True
            go = ~done
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return out


class PrefixTable:
    """Valid last token of every prefix of one byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        v = self.vocabulary
        data = self.data = self.data + more
        last, known, lengths, follows = self.last, v.by_bytes, v.lengths, v.follows
        for end in range(len(last), len(data) + 1):
            for n in lengths[data[end - 1]]:
                if n > end:
                    break
                token = known.get(data[end - n : end])
                if token is not None and (n == end or follows(last[end - n], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("no token ends here: the vocabulary lacks a byte")

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Edits the string; prefixes that end before ``start`` keep their tokens."""
        rest = new + self.data[stop:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.append(rest)

    def ids(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


#: Texts of smaller code points are split by a pattern of plain character classes.
NARROW = 0x250


def narrow_pattern(pattern: str) -> str:
    """The pattern with the classes it names written out for code points below ``NARROW``."""
    chars = [chr(c) for c in range(NARROW)]

    def members(name: str) -> str:
        belongs = regex.compile(name).fullmatch
        return "".join(f"\\u{ord(c):04x}" for c in chars if belongs(c))

    named = {name: members(name) for name in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    out, inside, at = [], False, 0
    while at < len(pattern):
        name = next((x for x in named if pattern.startswith(x, at)), None)
        if name:
            out.append(named[name] if inside else f"[{named[name]}]")
            at += len(name)
            continue
        step = 2 if pattern[at] == "\\" else 1
        inside = (inside or pattern[at] == "[") and pattern[at] != "]"
        out.append(pattern[at : at + step])
        at += step
    return "".join(out)


class Encoder:
    """Encodes pieces and remembers them."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self._split_any = regex.compile(pattern).findall
        self._wide = re.compile(f"[^\x00-{chr(NARROW - 1)}]").search
        try:
            self._split_narrow = re.compile(narrow_pattern(pattern)).findall
        except re.error:  # the pattern uses what only the other library knows
            self._split_narrow = self._split_any
        self.match = regex.compile(pattern).match
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return (self._split_any if self._wide(text) else self._split_narrow)(text)

    def learn(self, wanted: Iterable[str]) -> None:
        """Encodes the pieces that are not known yet."""
        known = self.known
        new = set(wanted).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(wanted)
        ranks, names, strings = self.vocabulary.ranks, [], []
        for piece in new:
            data = piece.encode()
            whole = ranks.get(data)
            if whole is not None:
                known[piece] = whole.to_bytes(4, "little")
            elif len(data) > WIDE or len(new) < FEW:
                known[piece] = self._alone(data)
            else:
                names.append(piece)
                strings.append(data)
        order = sorted(range(len(strings)), key=lambda k: -len(strings[k]))
        for k in range(0, len(order), SOLVED):
            some = order[k : k + SOLVED]
            known.update(zip([names[j] for j in some], self._solve([strings[j] for j in some])))

    def _alone(self, data: bytes) -> bytes:
        return np.array(PrefixTable(self.vocabulary, data).ids(), dtype="<u4").tobytes()

    def _solve(self, strings: list[bytes]) -> list[bytes]:
        """Prefix tables of many strings, longest first, one prefix length after the other."""
        v = self.vocabulary
        sizes = np.array([len(s) for s in strings], dtype=np.int64)
        rows, width = len(strings), int(sizes[0])
        data = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in strings]), dtype=np.uint8).reshape(rows, width).T
        prefix = np.zeros((width + 1, rows), dtype=np.uint64)
        for k in range(width):
            prefix[k + 1] = prefix[k] * np.uint64(v.base) + data[k] + np.uint64(1)
        last = np.full((width + 1, rows), -1, dtype=np.int32)
        reach = np.searchsorted(-sizes, -np.arange(width + 1), side="right")  # strings of that many bytes or more
        for end in range(1, width + 1):
            todo = np.arange(reach[end])
            key = prefix[end, : reach[end]]
            for n in range(min(end, v.longest), 0, -1):  # any order does: one length fits
                start = end - n
                found = v.table.get(key - prefix[start, todo] * v.powers[n])
                hit = np.flatnonzero(found >= 0)
                if not len(hit):
                    continue
                at, token = todo[hit], found[hit]
                if start:
                    good = v.follow_many(last[start, at], token)
                    hit, at, token = hit[good], at[good], token[good]
                last[end, at] = token
                rest = np.ones(len(todo), dtype=bool)
                rest[hit] = False
                todo, key = todo[rest], key[rest]
                if not len(todo):
                    break
        ids = np.zeros((rows, width), dtype="<u4")
        counts = np.zeros(rows, dtype=np.int64)
        at, row = sizes.copy(), np.arange(rows)
        while len(row):
            token = last[at[row], row]
            counts[row] += 1
            ids[row, width - counts[row]] = token
            at[row] -= v.sizes[token]
            row = row[at[row] > 0]
        flat = ids.tobytes()
        stop = 4 * width * np.arange(1, rows + 1)
        out = [flat[b - 4 * n : b] for b, n in zip(stop.tolist(), counts.tolist())]
        if self.decode(b"".join(out)) != b"".join(strings):  # two byte strings of one hash
            out = [self._alone(s) for s in strings]
        return out

    def split_all(self, texts: list[str]) -> Iterator[list[list[str]]]:
        """Pieces of the texts, some texts of about ``AT_ONCE`` characters together."""
        first = 0
        while first < len(texts):
            held, size = [], 0
            while first < len(texts) and (not held or size + len(texts[first]) <= AT_ONCE):
                held.append(self.split(texts[first]))
                size += len(texts[first])
                first += 1
            yield held

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for held in self.split_all(texts):
            wanted = set().union(*held)
            if len(wanted) <= REMEMBERED // 2:
                self.learn(wanted)
                for pieces in held:
                    yield b"".join(map(self.known.__getitem__, pieces))
                continue
            for pieces in held:  # one text of very many different pieces: in parts
                parts = []
                for k in range(0, len(pieces), REMEMBERED // 2):
                    part = pieces[k : k + REMEMBERED // 2]
                    self.learn(part)
                    parts.append(b"".join(map(self.known.__getitem__, part)))
                yield b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[k] for k in np.frombuffer(ids, dtype="<u4").tolist()])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (path or default_vocabulary(), pattern or default_pattern())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def encode_documents(
    docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None,
    keep: list[str] | None = None, ids: bool = True,
) -> DataFrame:
    """Adds token_ids (array of int, if ``ids``), n_tokens, ids_sha256 and decoded_sha256.

    ``keep`` names the columns to carry along (default: all). The decoded bytes come
    from the ids, not from the text. Columns that have one of the added names give way.
    """
    added = ["token_ids"] * ids + ["n_tokens", "ids_sha256", "decoded_sha256"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    fields = {f.name: f for f in docs.schema.fields}
    work = docs.select(*[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], docs[text].alias("_text"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(n).to_pylist()]
            made = {name: [] for name in added}
            for one in enc.encode_all(texts):
                if ids:
                    made["token_ids"].append(np.frombuffer(one, dtype="<i4"))
                made["n_tokens"].append(len(one) // 4)
                made["ids_sha256"].append(hashlib.sha256(one).hexdigest())
                made["decoded_sha256"].append(hashlib.sha256(enc.decode(one)).hexdigest())
            columns = [batch.column(i) for i in range(n)]
            kinds = {"token_ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            columns += [pa.array(made[c], type=kinds.get(c, pa.string())) for c in added]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *added])

    schema = T.StructType([fields[c] for c in keep])
    if ids:
        schema = schema.add("token_ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return work.mapInArrow(run, schema)
