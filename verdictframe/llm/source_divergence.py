"""Source divergence audit: how far the word frequencies of each source lie from its language and from other sources.

Single-pass in-memory indexing. A task reads documents into a block of postings (term, group: occurrences,
documents); a full block is sorted by hash shard and term and leaves the task as a run,
in rows of up to ``CHUNK`` terms. A shard's chunks come to one task in order of their first terms, where a heap
over the runs' cursors merges them; of each run one chunk is open. More than
``FAN_IN`` runs are merged in several levels. The last level sees all postings of a term at once, keeps the terms of
enough documents and gives frequencies.

A pair of sources differs in every kept term, though most terms occur in few sources. Its distance is taken
as if both held none (the smoothed floors), plus per source what its own terms change against a source without
them (sums over its values, and over the few values below the other's floor), plus a correction per term that both
hold. Only the last needs the sources of a term together; it is streamed through tasks that add up a matrix of ``SIDE``
x ``SIDE`` sources. Terms are dealt out by hash, sources of one language by block. Two
sources are one row per language in the result, as asked; nothing else grows with the pairs within a group.

Counts are 64-bit integers, products exact decimals. Values are exact up to 10**9 kept terms per language.

Defined results: null text, language and source count as ''; repeated rows are documents of their own; texts and terms of
any length are read whole (a longer text in parts, as one document); an empty table gives no rows; a
language without kept terms has ``pair`` rows of value 0; equal values rank by item; columns other than the three named do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm import textops
from verdictframe.llm.shared import stored

#: Documents of a language that must hold a term.
LEAST_DOCS = 30
#: Added to every count.
SMOOTHING = 5
SCALE = 1_000_000_000
#: Terms reported per group.
TOP = 50

#: Bytes of postings a task holds before it writes a run.
BLOCK_BYTES = 32 << 20
#: Bytes of text whose terms are found at once.
TEXT_BYTES = 1 << 20
#: Terms, and postings, of one row of a run.
CHUNK, CHUNK_POSTINGS = 1024, 1 << 13
#: Rows of a run handed over at once.
ROWS = 64
#: Runs merged at once.
FAN_IN = 256
#: Sources in a block of the pair corrections, and about the groups whose names a merging task remembers.
SIDE = 256
NAMES = 100_000

NOT_TERM = ~textops.table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))

RUNS = (
    "shard int, run long, first binary, terms array<binary>, sizes array<int>, langs array<string>, sources array<string>, "
    "codes array<int>, counts array<long>, docs array<long>"
)
FREQUENCIES = "lang string, term string, source string, n long, lang_n long, leads int"


# ------------------------------------------------------------------ blocks

def terms_of(part: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, number of each occurrence's term, its row) of some texts."""
    part = textops.ascii_lower(part)
    starts, ends = textops.spans(part, rows, NOT_TERM)
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = part[~NOT_TERM[part]]
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    encoded = found.dictionary_encode()
    which = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return encoded.dictionary, which, np.searchsorted(rows, starts, side="right") - 1


def totals(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of the values per key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1)) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[heads], *(np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values)


class Block:
    """Postings of the documents read since the last run was written."""

    def __init__(self, shards: int):
        self.shards = shards
        self.clear()

    def clear(self) -> None:
        self.names: dict[tuple[str, str], int] = {}
        self.held: list[tuple] = []
        self.bytes = 0

    def group(self, lang: str, source: str) -> int:
        return self.names.setdefault((lang, source), len(self.names))

    def add(self, terms: pa.Array, term: np.ndarray, code: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        small = (c.astype(np.int32) for c in (term, code))
        self.held.append((terms, *small, n, docs.astype(np.int32)))
        self.bytes += terms.nbytes + 20 * len(term)

    def add_texts(self, data: np.ndarray, bounds: np.ndarray, codes: np.ndarray) -> None:
        """Whole texts of the groups ``codes``."""
        for first, last in textops.chunks(bounds, TEXT_BYTES):
            part = data[bounds[first] : bounds[last]]
            rows = bounds[first : last + 1] - bounds[first]
            if len(part) > 2 * TEXT_BYTES:
                self.add_long(part, int(codes[first]))
                continue
            terms, which, row = terms_of(part, rows)
            if not len(which):
                continue
            once, n = totals(row * len(terms) + which, np.ones(len(which), dtype=np.int64))
            key, n, docs = totals(codes[first + once // len(terms)] * len(terms) + once % len(terms), n, np.ones(len(once), dtype=np.int64))
            self.add(terms, key % len(terms), key // len(terms), n, docs)

    def add_long(self, part: np.ndarray, code: int) -> None:
        """One text in pieces: the terms' counts over all pieces, as one document."""
        one = Block(1)
        for a, b in textops.pieces(part, NOT_TERM):
            terms, which, _ = terms_of(part[a:b], np.array([0, b - a]))
            term, n = totals(which, np.ones(len(which), dtype=np.int64))
            if len(term):
                one.add(terms, term, np.zeros(len(term), dtype=np.int64), n, np.zeros(len(term), dtype=np.int64))
                if one.bytes > BLOCK_BYTES:
                    one.compact()
        one.compact()
        for terms, term, _, n, _ in one.held:
            self.add(terms, term, np.full(len(term), code), n, np.ones(len(term), dtype=np.int64))

    def compact(self) -> None:
        """Equal (term, group) of what is held become one posting."""
        if len(self.held) < 2:
            return
        encoded = pa.concat_arrays([h[0] for h in self.held]).dictionary_encode()
        renamed = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        firsts = np.cumsum([0] + [len(h[0]) for h in self.held])
        term = np.concatenate([renamed[at + h[1]] for at, h in zip(firsts, self.held)])
        code, n, docs = (np.concatenate([h[k] for h in self.held]).astype(np.int64) for k in (2, 3, 4))
        width = int(code.max(initial=0)) + 1
        key, n, docs = totals(term * width + code, n, docs)
        self.held, self.bytes = [], 0
        self.add(encoded.dictionary, key // width, key % width, n, docs)

    def full(self) -> bool:
        """Whether a run must be written: even without repetitions the block is over half its size."""
        if self.bytes <= BLOCK_BYTES:
            return False
        self.compact()
        return self.bytes > BLOCK_BYTES // 2

    def run(self, number: int) -> Iterator[pa.RecordBatch]:
        """The block as a run sorted by shard and term; the block is empty afterwards."""
        self.compact()
        for terms, term, code, n, docs in self.held:
            lengths = pc.binary_length(terms).to_numpy(zero_copy_only=False).astype(np.int64)
            letters = np.frombuffer(b"".join(terms.to_pylist()), dtype=np.uint8)
            stops = np.cumsum(lengths)
            shard = (textops.hash_spans(letters, stops - lengths, stops) % np.uint64(self.shards)).astype(np.int32)
            order = pc.sort_indices(
                pa.table({"shard": shard, "term": terms}), sort_keys=[("shard", "ascending"), ("term", "ascending")]
            ).to_numpy()
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            place = np.argsort(rank[term] * len(self.names) + code)  # every pair occurs once
            sizes = np.bincount(rank[term], minlength=len(order))
            rows = chunk_rows(
                shard[order], number, terms.take(pa.array(order)), sizes, list(self.names), code[place], n[place], docs[place]
            )
            for k in range(0, rows.num_rows, ROWS):
                yield rows.slice(k, ROWS)
        self.clear()


def chunk_rows(
    shard: np.ndarray, number: int, terms: pa.Array, sizes: np.ndarray, names: list[tuple[str, str]],
    code: np.ndarray, n: np.ndarray, docs: np.ndarray,
) -> pa.RecordBatch:
    """Rows of RUNS: terms sorted by shard and name, cut where the shard changes or a row is full.

    Each row names its own groups. All postings of a term stay in one row.
    """
    until = np.concatenate([[0], np.cumsum(sizes)])
    edges, size = [0], len(terms)
    heads = np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)).tolist()[1:] + [size] if size else []
    for stop in heads:
        while edges[-1] < stop:
            at = edges[-1]
            by_postings = int(np.searchsorted(until, until[at] + CHUNK_POSTINGS, side="right")) - 1
            edges.append(min(stop, at + CHUNK, max(by_postings, at + 1)))
    langs, sources, own, groups = [], [], [], [0]
    for a, b in zip(edges, edges[1:]):
        used, renamed = np.unique(code[until[a] : until[b]], return_inverse=True)
        own.append(renamed)
        langs += [names[k][0] for k in used.tolist()]
        sources += [names[k][1] for k in used.tolist()]
        groups.append(groups[-1] + len(used))
    at = pa.array(edges, type=pa.int32())
    posts = pa.array(until[edges], type=pa.int32())
    groups = pa.array(groups, type=pa.int32())
    heads = np.array(edges[:-1], dtype=np.int64)

    def lists(offsets: pa.Array, values, kind) -> pa.Array:
        return pa.ListArray.from_arrays(offsets, pa.array(values, type=kind))

    codes = np.concatenate(own) if own else np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(shard[heads], type=pa.int32()), pa.array(np.full(len(heads), number), type=pa.int64()),
            terms.take(pa.array(heads)), pa.ListArray.from_arrays(at, terms), lists(at, sizes, pa.int32()),
            lists(groups, langs, pa.string()), lists(groups, sources, pa.string()),
            lists(posts, codes, pa.int32()), lists(posts, n, pa.int64()), lists(posts, docs, pa.int64()),
        ],
        names=[c.split()[0] for c in RUNS.split(", ")],
    )


def written_runs(docs: DataFrame, shards: int) -> DataFrame:
    """The documents' postings as runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(shards), TaskContext.get().partitionId() << 32
        for batch in batches:
            data, bounds = textops.column(batch, "text")
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            pairs = list(names)
            # spill between slices of a batch, so that a block stays near its size
            for first in range(0, len(pairs), 256):
                last = min(first + 256, len(pairs))
                codes = np.array([block.group(*p) for p in pairs[first:last]], dtype=np.int64)
                start, stop = int(bounds[first]), int(bounds[last])
                block.add_texts(data[start:stop], bounds[first : last + 1] - start, codes)
                if block.full():
                    yield from block.run(number)
                    number += 1
        yield from block.run(number)

    return docs.mapInArrow(run, RUNS)


# ------------------------------------------------------------------- merge

class Cursor:
    """An open chunk of a run and the term it stands at."""

    def __init__(self, row: pa.RecordBatch, names: dict[tuple[str, str], int]):
        one = {name: row.column(k)[0].values for k, name in enumerate(row.schema.names) if k > 2}
        self.terms = one["terms"].to_pylist()
        self.until = np.concatenate([[0], np.cumsum(one["sizes"].to_numpy())]).tolist()
        here = [names.setdefault(p, len(names)) for p in zip(one["langs"].to_pylist(), one["sources"].to_pylist())]
        self.codes = np.array(here, dtype=np.int64)[one["codes"].to_numpy()]
        self.n, self.docs = one["counts"].to_numpy(), one["docs"].to_numpy()
        self.at = 0

    def postings(self) -> tuple[np.ndarray, ...]:
        part = slice(self.until[self.at], self.until[self.at + 1])
        return self.codes[part], self.n[part], self.docs[part]


class Merged:
    """Terms in order with all their postings, held until a batch of them is taken."""

    def __init__(self):
        self.terms: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.sizes: list[int] = []

    def add(self, term: bytes, parts: list[tuple[np.ndarray, ...]]) -> None:
        self.terms.append(term)
        self.parts += parts
        self.sizes.append(sum(len(p[0]) for p in parts))

    def take(self, width: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms, number of the term, group, occurrences, documents) of what is held, one posting per term and group."""
        term = np.repeat(np.arange(len(self.terms)), self.sizes)
        code, n, docs = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        key, n, docs = totals(term * width + code, n, docs)
        terms = self.terms
        self.__init__()
        return terms, key // width, key % width, n, docs


def merge(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    """Merges chunks sorted by shard and first term. ``emit(shard, batch of terms, names)`` makes the rows.

    Chunks of a run follow one another, so a term below the first one of the chunk that comes next is complete.
    """
    heap: list[tuple[bytes, int, Cursor]] = []
    names: dict[tuple[str, str], int] = {}
    held, shard, number = Merged(), None, 0

    def ready(below: bytes | None) -> Iterator[pa.RecordBatch]:
        while heap and (below is None or heap[0][0] < below):
            term, parts = heap[0][0], []
            while heap and heap[0][0] == term:
                _, order, cursor = heap[0]
                parts.append(cursor.postings())
                cursor.at += 1
                if cursor.at < len(cursor.terms):
                    heapq.heapreplace(heap, (cursor.terms[cursor.at], order, cursor))
                else:
                    heapq.heappop(heap)
            held.add(term, parts)
            if len(held.terms) >= CHUNK or sum(held.sizes[-1:]) >= CHUNK_POSTINGS:
                yield from given()

    def given() -> Iterator[pa.RecordBatch]:
        if held.terms:
            yield from emit(shard, held.take(len(names)), list(names))

    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            here = row.column(0)[0].as_py()
            if here != shard:
                yield from ready(None)
                yield from given()
                shard = here
            yield from ready(row.column(2)[0].as_py())
            if len(names) > NAMES and not heap:
                yield from given()
                names.clear()
            heapq.heappush(heap, ((cursor := Cursor(row, names)).terms[0], number, cursor))
            number += 1
    yield from ready(None)
    yield from given()


def dealt(runs: DataFrame, *keys: str) -> DataFrame:
    partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(partitions, *keys).sortWithinPartitions(*keys, "first", "run")


def fewer_runs(runs: DataFrame, groups: int) -> DataFrame:
    """Runs merged into ``groups`` longer ones."""
    grouped = runs.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (batch.slice(k, 1) for batch in batches for k in range(batch.num_rows))
        for number, rows in groupby(every, key=lambda row: row.column(1)[0].as_py()):
            def emit(shard, taken, names, number=number):
                terms, term, code, n, docs = taken
                yield chunk_rows(
                    np.full(len(terms), shard, dtype=np.int32), number, pa.array(terms, type=pa.binary()),
                    np.bincount(term, minlength=len(terms)), names, code, n, docs,
                )

            yield from merge(rows, emit)

    return dealt(grouped, "run", "shard").mapInArrow(run, RUNS)


def frequencies(docs: DataFrame, least_docs: int = LEAST_DOCS, fan_in: int = FAN_IN) -> DataFrame:
    """(lang, term, source, n, lang_n, leads) of every term in ``least_docs`` documents of its language; ``leads`` is 1 once per term and language."""
    spark = docs.sparkSession
    runs = stored(written_runs(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "runs")
    while (count := runs.agg(F.count_distinct("run")).first()[0]) > fan_in:
        runs = stored(fewer_runs(runs, -(-count // fan_in)), "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(shard, taken, names):
            terms, term, code, n, docs = taken
            langs = {lang: k for k, lang in enumerate(dict.fromkeys(p[0] for p in names))}
            of_group = np.array([langs[p[0]] for p in names], dtype=np.int64)
            key = term * len(langs) + of_group[code]
            own, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            in_docs, in_all = np.zeros(len(own), dtype=np.int64), np.zeros(len(own), dtype=np.int64)
            np.add.at(in_docs, inverse, docs)
            np.add.at(in_all, inverse, n)
            leads = np.zeros(len(key), dtype=np.int32)
            leads[first] = 1
            keep = np.flatnonzero(in_docs[inverse] >= least_docs)
            if len(keep):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[k][0] for k in code[keep].tolist()], type=pa.string()),
                        pa.array([terms[k] for k in term[keep].tolist()], type=pa.binary()).cast(pa.string()),
                        pa.array([names[k][1] for k in code[keep].tolist()], type=pa.string()),
                        pa.array(n[keep]), pa.array(in_all[inverse][keep]), pa.array(leads[keep]),
                    ],
                    names=[c.split()[0] for c in FREQUENCIES.split(", ")],
                )

        yield from merge(batches, emit)

    return stored(dealt(runs, "shard").mapInArrow(run, FREQUENCIES), "frequencies")


# ------------------------------------------------------------------ values

def smoothed(n: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)); null without terms."""
    n = F.col(n) if isinstance(n, str) else n
    above = (n + SMOOTHING).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.col(total).cast("decimal(20,0)") + F.col(terms).cast("decimal(20,0)") * SMOOTHING
    return F.call_function("div", above, F.nullif(below, F.lit(0))) + 1


def small_side(df: DataFrame, rows: int = 50_000, size: int = 4 << 20) -> DataFrame:
    """A broadcast hint if the names of ``df`` (lang, source and numbers) are few and short, else ``df``."""
    found = df.limit(rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("lang") + F.octet_length("source")).alias("size")
    ).first()
    return F.broadcast(df) if found["n"] <= rows and (found["size"] or 0) <= size else df


def group_totals(names: DataFrame, found: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms, sources, floor) of every group; floor is the value of a term it does not hold."""
    totals_of = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = found.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("leads").alias("terms"))
    sources = names.groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    joined = names.join(totals_of, ["lang", "source"], "left").join(langs, "lang", "left").join(sources, "lang")
    joined = joined.fillna(0, ["total", "lang_total", "terms"])
    return joined.withColumn("floor", smoothed(F.lit(0).cast("long"), "total", "terms"))


def common_term_corrections(valued: DataFrame, rows: int, side: int = SIDE) -> DataFrame:
    """(lang, s, t, correction), s < t: what the terms that both sources hold add to the sum of the one-sided changes.

    ``valued`` has p and floor per (lang, term, source). The term shards number so few that their
    partial sums never outgrow the rows.
    """
    spark = valued.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = valued.agg(F.max("sources")).first()[0] or 1
    shards = max(1, min(partitions, 2 * rows // (most * most)))
    blocks = F.ceil(F.col("sources") / side).cast("int")
    block = F.pmod(F.xxhash64("source"), blocks).cast("int")
    units = valued.filter("n < lang_n").withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))
    ).select(
        "lang", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int").alias("k"), "term", "source", "block", "p", "floor",
    )
    keys = ["lang", "a", "b", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sums = None, None
        open_term, held = None, []
        for batch in batches:
            lang, term = (batch.column(k).dictionary_encode() for k in (0, 4))
            a, b, k, block, p, floor = (batch.column(c).to_numpy() for c in (1, 2, 3, 6, 7, 8))
            source = batch.column(5).dictionary_encode()
            code = source.indices.to_numpy()
            names = source.dictionary.to_pylist()
            marks = np.stack([lang.indices.to_numpy(), a, b, k, term.indices.to_numpy()])
            heads = np.flatnonzero((np.diff(marks, axis=1, prepend=marks[:, :1] - 1) != 0).any(axis=0))
            for lo, hi in zip(heads.tolist(), [*heads[1:].tolist(), batch.num_rows]):
                here = (lang[lo].as_py(), int(a[lo]), int(b[lo]), int(k[lo]))
                if (here, term[lo].as_py()) != open_term:
                    if held:
                        sums.add(*(np.concatenate(c) for c in zip(*held)))
                    open_term, held = (here, term[lo].as_py()), []
                if here != unit:
                    if sums:
                        yield sums.rows()
                    unit, sums = here, PairSums(*here[:3])
                held.append((sums.number(names, code[lo:hi]), block[lo:hi], p[lo:hi], floor[lo:hi]))
        if held:
            sums.add(*(np.concatenate(c) for c in zip(*held)))
        if sums:
            yield sums.rows()

    parts = units.repartition(partitions, *keys).sortWithinPartitions(*keys, "term", "source").mapInArrow(
        run, "lang string, s string, t string, correction long"
    )
    return parts.groupBy(
        "lang", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")
    ).agg(F.sum("correction").alias("correction"))


class PairSums:
    """Corrections of the source pairs of two blocks of one language, added up over terms."""

    def __init__(self, lang: str, a: int, b: int):
        self.lang, self.a, self.b = lang, a, b
        self.numbers: dict[str, int] = {}
        self.sums = np.zeros((32, 32), dtype=np.int64)

    def number(self, names: list[str], code: np.ndarray) -> np.ndarray:
        return np.array([self.numbers.setdefault(names[c], len(self.numbers)) for c in code.tolist()], dtype=np.int64)

    def add(self, at: np.ndarray, block: np.ndarray, p: np.ndarray, floor: np.ndarray) -> None:
        """One term with its holders."""
        while len(self.numbers) > len(self.sums):
            self.sums = np.pad(self.sums, ((0, len(self.sums)), (0, len(self.sums))))
        if self.a == self.b:
            left = right = slice(None)
        else:
            left, right = block == self.a, block == self.b
        p1, f1, p2, f2 = p[left, None], floor[left, None], p[None, right], floor[None, right]
        both = np.abs(p1 - p2) - np.abs(p1 - f2) - np.abs(f1 - p2) + np.abs(f1 - f2)
        self.sums[at[left, None], at[None, right]] += both

    def rows(self) -> pa.RecordBatch:
        if self.a == self.b:
            self.sums = np.triu(self.sums, 1)
        i, j = np.nonzero(self.sums)
        names = pa.array(list(self.numbers), type=pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * len(i), type=pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(self.sums[i, j])],
            names=["lang", "s", "t", "correction"],
        )


def pair_distances(valued: DataFrame, totals_of: DataFrame, rows: int, side: int = SIDE) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, in both directions."""
    own = valued.groupBy("lang", "source").agg(F.sum("p").alias("held_p"), F.count(F.lit(1)).alias("held"))
    one = totals_of.join(own, ["lang", "source"], "left").fillna(0, ["held_p", "held"]).select(
        "lang", "source", "terms", "floor", "held_p", "held"
    )
    # values below another source's floor, of which a source has few different ones
    highest = totals_of.groupBy("lang").agg(F.max("floor").alias("highest"))
    low = valued.join(small_side(highest.withColumn("source", F.lit(""))).drop("source"), "lang").filter("p < highest").groupBy(
        "lang", "source", "floor", "p"
    ).agg(F.count(F.lit(1)).alias("n"))
    other = totals_of.select("lang", F.col("source").alias("t"), F.col("floor").alias("t_floor"))
    below = low.withColumnRenamed("source", "s").join(small_side(other.withColumnRenamed("t", "source")).withColumnRenamed("source", "t"), "lang").filter(
        "p < t_floor AND floor < t_floor AND s <> t"
    ).groupBy("lang", "s", "t").agg(F.sum(F.col("n") * 2 * (F.col("t_floor") - F.col("p"))).alias("low"))
    low_s = below.select("lang", "s", "t", F.col("low").alias("low_s"))
    low_t = below.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), F.col("low").alias("low_t"))
    names = ["source", "floor", "held_p", "held"]
    s = one.select("lang", "terms", *[F.col(c).alias(f"s_{c}") for c in names])
    t = one.select("lang", *[F.col(c).alias(f"t_{c}") for c in names])
    pairs = s.join(t, "lang").filter("s_source < t_source").withColumnsRenamed({"s_source": "s", "t_source": "t"})
    pairs = pairs.join(low_s, ["lang", "s", "t"], "left").join(low_t, ["lang", "s", "t"], "left")
    pairs = pairs.join(common_term_corrections(valued, rows, side), ["lang", "s", "t"], "left")

    def change(a: str, b: str, part: str) -> Column:
        plain = F.col(f"{a}_held_p") - F.col(f"{a}_held") * F.col(f"{a}_floor")
        over = F.col(f"{a}_held_p") + F.col(f"{a}_held") * (F.col(f"{a}_floor") - 2 * F.col(f"{b}_floor")) + F.coalesce(part, F.lit(0))
        return F.when(F.col(f"{b}_floor") <= F.col(f"{a}_floor"), plain).otherwise(over)

    value = F.col("terms") * F.abs(F.col("s_floor") - F.col("t_floor")) + change("s", "t", "low_s") + change("t", "s", "low_t")
    value = F.coalesce(value + F.coalesce("correction", F.lit(0)), F.lit(0)).cast("long")
    pairs = stored(pairs.select("lang", "s", "t", value.alias("value")), "pairs")
    return pairs.select("lang", F.col("s").alias("source"), F.col("t").alias("item"), "value").unionByName(
        pairs.select("lang", F.col("t").alias("source"), F.col("s").alias("item"), "value")
    )


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, fan_in: int = FAN_IN, side: int = SIDE) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source (``pair``) and the ``top`` terms above the language's share (``term``)."""
    docs = docs.select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])
    names = stored(docs.select("lang", "source").distinct(), "groups")
    found = frequencies(docs, least_docs, fan_in)
    totals_of = stored(group_totals(names, found), "groups")
    valued = found.join(small_side(totals_of), ["lang", "source"]).withColumns({
        "p": smoothed("n", "total", "terms"), "q": smoothed("lang_n", "lang_total", "terms"),
    }).select("lang", "term", "source", "n", "lang_n", "sources", "floor", "p", "q")
    valued = stored(valued, "values")
    pairs = pair_distances(valued, totals_of, valued.count(), side)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = valued.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
