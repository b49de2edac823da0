"""Benchmark decontamination by a BM25 index with block-max bounds.

Test items are cut into segments of at most ``SEGMENT`` words and indexed: per term the
segments that hold it with their BM25 impact, divided by the score the segment gives
itself, in blocks of ``BLOCK`` segments with the largest impact of each block. Every passage of a
document (``2 * SEGMENT`` words, half overlapping the next) is a query. A passage only
goes on to a block whose bounds add up to the threshold; there, WAND with
block-max checks scores segments in order and skips what cannot reach it. A hit counts when the passage's
neighbourhood holds the item's question and its answer (the last sentence; the whole item where it is one sentence):
``OVERLAP`` of the different words of each, of short ones all but one, and against chance ``ORDER`` of
the item's pairs of following words. So items with a few words changed are found, too.

The index is cut into shards of ``SHARD`` segments, the bound of what a task gets; documents
are read once per shard. Words are runs of letters and digits, lower case.

Defined results: null and empty texts match nothing; items without words are left out; a
null doc_id is carried along; repeated rows match alike; repeated item ids are one item per text. Ties: of several
passages the best score counts, then the first.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictframe.llm import textops

SEGMENT = 32
BLOCK = 8
SHARD = 20_000
#: (word, block) pairs whose bounds are added up at once.
PAIRS_AT_ONCE = 500_000
K1, B = 1.2, 0.75
#: Share of a segment's own score that a passage must reach.
THRESHOLD = 0.6
#: Share of an item that must be found again.
OVERLAP = 0.8
#: Share of its pairs of following words.
ORDER = 0.5
#: Share of the threshold that the most frequent terms may hold together in any segment.
COMMON = 0.25

LAST_SENTENCE = re.compile(r"(?s)^(.*[.!?\n])\s*([^.!?\n]*\w[^.!?\n]*[.!?]*\s*)$")


def words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    found = [h for *_, h, _ in textops.hashed_runs(data, np.array([0, len(data)]), textops.NOT_ALNUM, textops.latin_lower)]
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)


def item_parts(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the item, its question and its answer."""
    whole = words_of(text)
    found = LAST_SENTENCE.match(text)
    question, answer = (words_of(found[1]), words_of(found[2])) if found else (whole, whole)
    return whole, question if len(question) else whole, answer if len(answer) else whole


def segment_bounds(n: int) -> list[tuple[int, int]]:
    count = max(1, math.ceil(n / SEGMENT))
    cuts = [n * k // count for k in range(count + 1)]
    return list(zip(cuts, cuts[1:]))


def postings(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """One row per (item, segment, term) with its count, for the statistics of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, value in enumerate(batch.column(1)):
                words = words_of(value.as_py() or "")
                if not len(words):
                    continue
                fields = batch.column(0)[at].as_py(), batch.column(2)[at].as_py()
                for part, (a, b) in enumerate(segment_bounds(len(words))):
                    terms, counts = np.unique(words[a:b], return_counts=True)
                    rows += [(*fields, part, t, c, b - a) for t, c in zip(terms.view(np.int64).tolist(), counts.tolist())]
            names = ["item", "same", "part", "term", "tf", "size"]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = [batch.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(columns, kinds)], names=names)

    kind = items.schema[key].dataType
    schema = T.StructType([T.StructField("item", kind)])
    for name, of in (("same", "long"), ("part", "integer"), ("term", "long"), ("tf", "integer"), ("size", "integer")):
        schema = schema.add(name, of)
    work = items.select(F.col(key).alias("item"), F.col(text).alias("text"), F.xxhash64(text).alias("same"))
    return work.dropDuplicates(["item", "same"]).mapInArrow(run, schema)


def impacts(rows: DataFrame) -> DataFrame:
    """Postings with the BM25 impact as a share of the segment's own score, and the shard of the segment."""
    segments = rows.select("item", "same", "part", "size").distinct()
    total = segments.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    n, mean = total["n"], total["mean"] or 1.0
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean)))
    scored = rows.join(df, "term").withColumn("impact", idf * tf)
    own = scored.groupBy("item", "same", "part").agg(F.sum("impact").alias("own"))
    shards = shard_count(n)
    joined = scored.alias("a").join(
        own.alias("b"),
        F.col("a.item").eqNullSafe(F.col("b.item")) & (F.col("a.same") == F.col("b.same")) & (F.col("a.part") == F.col("b.part")),
    )
    return joined.select(
        "a.item", "a.same", "a.part", "a.term", "a.df", (F.col("impact") / F.col("own")).alias("impact"),
        F.pmod(F.col("a.same"), F.lit(shards)).alias("shard"),
    )


def shard_count(segments: int) -> int:
    return max(1, math.ceil(segments / SHARD))


class Index:
    """One shard: postings by term in blocks of segments, and the words of its items."""

    def __init__(self, rows: list, items: list[tuple]):
        self.items = [(key, *item_parts(text)) for key, _, text in items]
        number = {(key, same): k for k, (key, same, _) in enumerate(items)}
        parts = sorted({(number[r["item"], r["same"]], r["part"]) for r in rows})
        segment = {p: k for k, p in enumerate(parts)}
        self.item_of = np.array([p[0] for p in parts], dtype=np.int64)
        terms = np.array([r["term"] for r in rows], dtype=np.int64).view(np.uint64)
        docs = np.array([segment[number[r["item"], r["same"]], r["part"]] for r in rows], dtype=np.int64)
        impact = np.array([r["impact"] for r in rows], dtype=np.float64)
        order = np.lexsort((docs, terms))
        self.docs, self.impact = docs[order], impact[order]
        self.terms, first = np.unique(terms[order], return_index=True)
        self.first = np.append(first, len(order))
        self._common(len(parts))
        self._blocks()
        self.filter = np.zeros(1 << 16, dtype=bool)
        self.filter[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def _common(self, segments: int) -> None:
        """The longest lists leave the first step as long as no segment owes them more than ``COMMON``."""
        held = np.zeros(segments)
        self.essential = np.ones(len(self.terms), dtype=bool)
        sizes = np.diff(self.first)
        for t in np.argsort(-sizes, kind="stable"):
            if sizes[t] < 2:
                break
            cut = slice(self.first[t], self.first[t + 1])
            if (held[self.docs[cut]] + self.impact[cut]).max() <= COMMON:
                held[self.docs[cut]] += self.impact[cut]
                self.essential[t] = False

    def _blocks(self) -> None:
        """(block, largest impact) of every term."""
        block = self.docs // BLOCK
        term = np.repeat(np.arange(len(self.terms)), np.diff(self.first))
        new = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (term[1:] != term[:-1])))
        self.block_no = block[new]
        self.block_max = np.maximum.reduceat(self.impact, new)
        self.block_first = np.searchsorted(term[new], np.arange(len(self.terms) + 1))

    def lookup(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words that are terms, and the terms."""
        at = np.flatnonzero(self.filter[(words & np.uint64(0xFFFF)).astype(np.int64)])
        t = np.searchsorted(self.terms, words[at])
        t[t == len(self.terms)] = 0
        good = self.terms[t] == words[at]
        return at[good], t[good]

    def survivors(self, at: np.ndarray, t: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, passage, block) whose block bounds of the essential terms reach the rest of the threshold."""
        keep = self.essential[t]
        at, t = at[keep], t[keep]
        doc = np.searchsorted(bounds, at, side="right") - 1
        half = (at - bounds[doc]) // SEGMENT
        # a word lies in the passage that starts in its half and in the one before; a word repeated adds too much, never too little
        base = np.concatenate([[0], np.cumsum(np.diff(bounds) // SEGMENT + 2)])
        first = base[doc] + half
        count = self.block_first[t + 1] - self.block_first[t]
        kept = []
        held = np.cumsum(count)
        begin = 0
        while begin < len(t):
            # whole halves, as many as make PAIRS_AT_ONCE pairs; the half before is read again for the passage on the cut
            done = held[begin - 1] if begin else 0
            stop = int(np.searchsorted(held, done + PAIRS_AT_ONCE, side="right"))
            stop = int(np.searchsorted(first, first[max(stop - 1, begin)], side="right"))
            again = int(np.searchsorted(first, first[begin] - 1))
            high = int(first[stop - 1])
            behind = stop == len(t) or first[stop] > high + 1  # nothing more comes for the passage behind
            kept.append(self._bounded(first[again:stop], t[again:stop], int(first[begin]), high + behind))
            begin = stop
        passage, block = (np.concatenate(c) for c in zip(*kept)) if kept else (np.zeros(0, dtype=np.int64),) * 2
        doc = np.searchsorted(base, passage - 1, side="right") - 1
        # the passage before a document's first half holds a part of its first passage only
        real = passage - 1 >= base[np.maximum(doc, 0)]
        return doc[real], (passage - 1 - base[doc])[real], block[real]

    def _bounded(self, first: np.ndarray, t: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, block) that reach the bound, of the passages low .. high."""
        count = self.block_first[t + 1] - self.block_first[t]
        row = np.repeat(np.arange(len(t)), count)
        entry = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.block_first[t], count)
        blocks = int(self.block_no.max()) + 1 if len(self.block_no) else 1
        passage = np.concatenate([first[row] + 1, first[row]])  # shifted by one: the passage before the first half is 0
        key = passage * blocks + np.tile(self.block_no[entry], 2)
        keys, back = np.unique(key, return_inverse=True)
        bound = np.bincount(back, weights=np.tile(self.block_max[entry], 2), minlength=len(keys))
        good = keys[bound >= THRESHOLD - COMMON - 1e-9]
        passage, block = good // blocks, good % blocks
        own = (passage >= low) & (passage <= high)
        return passage[own], block[own]

    def wand(self, terms: np.ndarray, blocks: np.ndarray) -> list[tuple[int, float]]:
        """Segments of the blocks that the terms give ``THRESHOLD`` or more; document-at-a-time."""
        found = []
        lists = []
        for t in terms:
            a, b = self.block_first[t], self.block_first[t + 1]
            lists.append((self.docs[self.first[t] : self.first[t + 1]], self.impact[self.first[t] : self.first[t + 1]],
                          dict(zip(self.block_no[a:b].tolist(), self.block_max[a:b].tolist())), float(self.block_max[a:b].max())))
        for block in blocks.tolist():
            stop = (block + 1) * BLOCK
            here = [x for x in lists if block in x[2]]
            if sum(x[2][block] for x in here) < THRESHOLD - 1e-9:
                continue
            cursors = [[int(np.searchsorted(x[0], block * BLOCK)), x] for x in here]
            while True:
                cursors = [c for c in cursors if c[0] < len(c[1][0]) and c[1][0][c[0]] < stop]
                cursors.sort(key=lambda c: c[1][0][c[0]])
                bound, pivot = 0.0, None
                for c in cursors:
                    bound += c[1][2][block]
                    if bound >= THRESHOLD - 1e-9:
                        pivot = int(c[1][0][c[0]])
                        break
                if pivot is None:
                    break
                score = 0.0
                for c in cursors:
                    docs = c[1][0]
                    if docs[c[0]] < pivot:
                        c[0] += int(np.searchsorted(docs[c[0] :], pivot))
                    if c[0] < len(docs) and docs[c[0]] == pivot:
                        score += float(c[1][1][c[0]])
                        c[0] += 1
                if score >= THRESHOLD - 1e-9:
                    found.append((pivot, score))
        return found

    def overlap(self, item: int, words: np.ndarray) -> float | None:
        """The smaller share of question and answer found in the words; None if they do not hold the item."""
        _, whole, question, answer = self.items[item]
        if np.isin(textops.shingles(whole, 2), textops.shingles(words, min(2, len(whole)))).mean() < ORDER:
            return None
        mine, shares = np.unique(words), []
        for part in (question, answer):
            part = np.unique(part)
            missing = len(part) - int(np.isin(part, mine).sum())
            if missing > max(math.floor((1 - OVERLAP) * len(part) + 1e-9), min(1, len(part) - 1)):
                return None
            shares.append(1 - missing / len(part))
        return min(shares)

    def matches(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, dict[int, tuple[float, float, int]]]:
        """Per document: item -> (overlap, score, first word of the passage)."""
        at, t = self.lookup(words)
        doc, passage, block = self.survivors(at, t, bounds)
        out: dict[int, dict[int, tuple[float, float, int]]] = {}
        if not len(doc):
            return out
        cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (passage[1:] != passage[:-1])))
        for a, b in zip(cuts, np.append(cuts[1:], len(doc))):
            d = int(doc[a])
            start = int(bounds[d] + passage[a] * SEGMENT)
            stop = min(start + 2 * SEGMENT, int(bounds[d + 1]))
            i, j = np.searchsorted(at, (start, stop))
            for segment, score in self.wand(np.unique(t[i:j]), block[a:b]):
                item = int(self.item_of[segment])
                size = len(self.items[item][1])
                near = words[max(start - size, int(bounds[d])) : min(stop + size, int(bounds[d + 1]))]
                share = self.overlap(item, near)
                if share is not None:
                    best = out.setdefault(d, {})
                    place = start - int(bounds[d])
                    if item not in best or (score, -place) > (best[item][1], -best[item][2]):
                        best[item] = (share, score, place)
        return out


def build_index(items: DataFrame, key: str = "item_id", text: str = "text") -> list[Index]:
    """The shards of the index; statistics are gathered over all items, a shard is collected at its bounded size."""
    found = postings(items, key, text).cache()
    scored = impacts(found).cache()
    shards = shard_count(scored.select("item", "same", "part").distinct().count())
    texts = items.select(F.col(key).alias("item"), F.xxhash64(text).alias("same"), F.col(text).alias("text")).dropDuplicates(["item", "same"])
    out = []
    for shard in sorted(r["shard"] for r in scored.select("shard").distinct().collect()):
        rows = scored.filter(F.col("shard") == shard).collect()
        used = {(r["item"], r["same"]) for r in rows}
        mine = texts.filter(F.pmod("same", F.lit(shards)) == shard).collect()
        out.append(Index(rows, sorted(((r["item"], r["same"], r["text"]) for r in mine if (r["item"], r["same"]) in used),
                                      key=lambda r: (r[0] is None, r[0] or 0, r[1]))))
    scored.unpersist()
    found.unpersist()
    return out


MATCH = "array<struct<item_id: {kind}, overlap: double, score: double, first_word: long>>"


def with_matches(docs: DataFrame, index: Index, kind: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``matches``: the items of one shard found in each document, by item id."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "matches"]
    fields = {f.name: f for f in docs.schema.fields}
    work = docs.select(*[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)], docs[text].alias("_text"))
    n = len(keep)
    ids = T._parse_datatype_string(kind)
    from pyspark.sql.pandas.types import to_arrow_type

    struct = pa.struct([("item_id", to_arrow_type(ids)), ("overlap", pa.float64()), ("score", pa.float64()), ("first_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index  # SHARD segments at most travel with the task
        for batch in batches:
            data, bounds = textops.column(batch, "_text")
            found: list = [[] for _ in range(batch.num_rows)]
            for first, _, words, rows in textops.hashed_runs(data, bounds, textops.NOT_ALNUM, textops.latin_lower):
                for d, hits in ix.matches(words, rows).items():
                    found[first + d] = [
                        {"item_id": ix.items[i][0], "overlap": o, "score": s, "first_word": w}
                        for i, (o, s, w) in sorted(hits.items())
                    ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n)] + [pa.array(found, type=pa.list_(struct))], names=[*keep, "matches"]
            )

    schema = T.StructType([fields[c] for c in keep]).add("matches", T._parse_datatype_string(MATCH.format(kind=kind)))
    return work.mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """One row per document and benchmark item found in it."""
    kind = items.schema[item_key].dataType.simpleString()
    parts = [
        with_matches(docs, ix, kind, keep=[key]).filter(F.size("matches") > 0).select(key, F.inline("matches"))
        for ix in build_index(items, item_key)
    ]
    if not parts:
        schema = T.StructType([docs.schema[key]])
        empty = docs.sparkSession.createDataFrame([], schema)
        return empty.select(key, F.inline(F.lit(None).cast(MATCH.format(kind=kind))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, item_key: str = "item_id") -> DataFrame:
    """The documents in which no benchmark item is found, with their columns."""
    kind = items.schema[item_key].dataType.simpleString()
    columns = docs.columns
    for ix in build_index(items, item_key):
        docs = with_matches(docs, ix, kind).filter(F.size("matches") == 0).select(*columns)
    return docs
