"""Repeated line runs by a distributed suffix array.

The corpus is one sequence of line ids per document (lines without words are left
out). Lines that occur once end every repeated run, so only the others
take part. Prefix doubling ranks, round by round, the runs of 1, 2, 4, ... lines that start
at each position: the pair (rank here, rank 2**k lines on) is counted, pairs that occur
once drop out, the others are sorted across the cluster and numbered, until no pair occurs twice. The ranks order
the suffixes by their first 2**k lines.

The intervals of suffixes with a longest common prefix then come from the levels, from the highest down. An interval of
length m is split by the ranks of the 2**k lines behind its m lines: suffixes that agree form an interval of length m + 2**k,
and the first of them stays in the old one for all. Behind level 0 no two suffixes of an interval agree in one more
line, so m is their common prefix exactly, and the intervals are those of the suffix array. Positions whose
line always stands behind the same line begin no maximal run and stay out. An interval is named by its first
position and its length: the first copy. Every other suffix in it begins a later copy, whose lines are deleted. Each
step is a group-by and a join on keys that are aggregated before; no task holds a hot interval.

A run counts from ``min_words`` words on: the queries pass ``EVERY_RUN``, so every
maximal repeated run counts; ``MIN_WORDS`` is the default of direct callers.

Order is (doc_id, hash of the text, line), null ids first. Defined results: null and empty
texts stay as they are; repeated rows (same id and text) count as one document and get the
same result; a line deleted takes its line end along, and blank lines inside a deleted run go with it; other columns are kept. ``text`` shows what is left, ``lines_deleted``
how many lines went, ``longest_run`` the lines of the longest run of which the document holds a later copy and
``run_copies`` how often that run occurs (null without one). A text can become empty. Every different line stays somewhere once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.llm import textops
from verdictframe.llm.shared import numbered, stored

#: Words from which a repeated run is a copy.
MIN_WORDS = 20
#: Every line here has a word, so from one word on no repeated run is too short.
EVERY_RUN = 1

#: A word, as ``textops.SPACES`` part them.
SEPARATED = re.compile(r"[^ \t\n\v\f\r]+")
LINES = "d long, t long, line int, a long, b long"


def line_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with words: document key (d, t), number among such lines, id (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = textops.column(batch, "text")
            ids = [batch.column(0), batch.column(1)]
            for first, last in textops.chunks(bounds):
                part = data[bounds[first] : bounds[last]]
                rows = bounds[first : last + 1] - bounds[first]
                if not len(part):
                    continue
                ends = np.flatnonzero(part == 10)
                starts = np.unique(np.concatenate([rows[:-1][rows[:-1] < len(part)], ends + 1]))
                starts = starts[starts < len(part)]
                doc = np.searchsorted(rows, starts, side="right") - 1
                stops = np.append(starts[1:], len(part))
                stops = stops - ((stops > starts) & (part[np.maximum(stops - 1, 0)] == 10))
                words = np.zeros(len(part) + 1, dtype=np.int64)
                begins, _ = textops.spans(part, rows, textops.SPACES)
                words[begins + 1] = 1
                words = np.cumsum(words)
                count = words[stops] - words[starts]
                keep = np.flatnonzero(count > 0)
                starts, stops, doc = starts[keep], stops[keep], doc[keep]
                a = textops.hash_spans(part, starts, stops, 0).view(np.int64)
                b = textops.hash_spans(part, starts, stops, 1).view(np.int64)
                line = np.arange(len(doc)) - np.searchsorted(doc, doc)
                at = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [ids[0].take(at), ids[1].take(at), pa.array(line.astype(np.int32)), pa.array(a), pa.array(b)],
                    names=["d", "t", "line", "a", "b"],
                )

    work = docs.select(F.col(key).cast("long").alias("d"), F.xxhash64(text).alias("t"), F.col(text).alias("text"))
    return work.mapInArrow(run, LINES)


def repeated_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, line, r) of the lines that occur more than once, and the documents (n, d, t) that hold them, numbered in order."""
    repeated = lines.groupBy("a", "b").count().filter("count > 1").select("a", "b")
    ids = numbered(repeated, ["a", "b"], "r", "ranks")
    found = stored(lines.join(ids, ["a", "b"]).select("d", "t", "line", "r").distinct(), "lines")
    docs = numbered(found.select("d", "t").distinct(), ["d", "t"], "n", "numbers")
    own = docs.select(F.col("d").alias("_d"), F.col("t").alias("_t"), "n")
    placed = found.join(own, F.col("d").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t")))
    return stored(placed.select("n", "line", "r"), "level"), docs


def ranked_runs(first: DataFrame) -> list[DataFrame]:
    """Per level k the ranks (n, line, r) of the runs of 2**k lines that occur more than once."""
    levels = [first]
    while True:
        level, step = levels[-1], 1 << (len(levels) - 1)
        behind = level.select("n", (F.col("line") - step).alias("line"), F.col("r").alias("y"))
        pairs = stored(level.withColumnRenamed("r", "x").join(behind, ["n", "line"]), "pairs")
        ranks = numbered(pairs.groupBy("x", "y").count().filter("count > 1").select("x", "y"), ["x", "y"], "r", "ranks")
        if ranks.isEmpty():
            return levels
        levels.append(stored(pairs.join(ranks, ["x", "y"]).select("n", "line", "r"), "level"))


def run_starts(first: DataFrame) -> DataFrame:
    """(n, line) at which a maximal run may begin: not all of the line's copies stand behind copies of one line."""
    before = first.select("n", (F.col("line") + 1).alias("line"), F.col("r").alias("left"))
    both = stored(first.join(before, ["n", "line"], "left"), "starts")
    several = (F.count("left") < F.count(F.lit(1))) | (F.min("left") < F.max("left"))
    # stored, so that the join deals out both sides anew and may split a frequent line
    open_lines = stored(both.groupBy("r").agg(several.alias("open")).filter("open").select("r"), "open")
    return both.join(open_lines, "r").select("n", "line")


def intervals(levels: list[DataFrame]) -> DataFrame:
    """(n, line, fn, fl, size, copies): each suffix in its interval, which is named by its first copy (fn, fl) and its lines.

    ``copies`` counts all suffixes of the interval. A suffix that speaks for a longer interval is in both.
    """
    root = run_starts(levels[0]).select(
        "n", "line", F.lit(-1).cast("long").alias("fn"), F.lit(-1).alias("fl"), F.lit(0).alias("size"),
        F.lit(0).cast("long").alias("copies"), F.lit(1).cast("long").alias("weight"),
    )
    members, group = root, ["fn", "fl", "size", "r"]
    for k in range(len(levels) - 1, -1, -1):
        ranks = levels[k].select(F.col("n").alias("_n"), F.col("line").alias("_line"), "r")
        here = (F.col("n") == F.col("_n")) & (F.col("line") + F.col("size") == F.col("_line"))
        keyed = stored(members.join(ranks, here, "left").drop("_n", "_line"), "members")
        place = F.struct("n", "line")
        agree = keyed.filter("r IS NOT NULL").groupBy(*group).agg(
            F.min(place).alias("first"), F.count(F.lit(1)).alias("held"), F.sum("weight").alias("all")
        ).filter("held > 1").drop("held")
        # stored, so that the join deals out both sides anew and may split a hot interval
        split = keyed.join(stored(agree, "splits"), group, "left")

        def row(fn, fl, size, copies, weight):
            return F.struct(
                F.col(fn).alias("fn"), F.col(fl).cast("int").alias("fl"), size.alias("size"), F.col(copies).alias("copies"), F.col(weight).alias("weight")
            )

        old = row("fn", "fl", F.col("size"), "copies", "weight")
        new = row("first.n", "first.line", F.col("size") + (1 << k), "all", "weight")
        speaker = row("fn", "fl", F.col("size"), "copies", "all")
        rows = F.when(F.col("first").isNull(), F.array(old)).when(F.col("first") == place, F.array(new, speaker)).otherwise(F.array(new))
        members = split.select("n", "line", F.inline(rows))
    return members.filter("size > 0").drop("weight")


def deleted_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, t, runs): the later copies in each document as (first line, lines, copies), counted among its lines with words."""
    first, numbers = repeated_lines(stored(line_rows(docs, key, text), "lines"))
    found = intervals(ranked_runs(first))
    later = found.filter("n <> fn OR line <> fl").groupBy("n").agg(
        F.collect_set(F.struct("line", "size", "copies")).alias("runs")
    )
    return later.join(numbers, "n").select("d", "t", "runs")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated line runs, with ``lines_deleted``, ``longest_run`` and ``run_copies``."""
    added = ["lines_deleted", "longest_run", "run_copies"]
    gone = stored(deleted_lines(docs, key, text), "ranges")
    gone = gone.select(F.col("d").alias("__gd"), F.col("t").alias("__gt"), F.col("runs").alias("__runs"))
    columns = [c for c in docs.columns if c not in added]
    work = docs.select(*[docs[c] for c in columns], F.col(key).cast("long").alias("__d"), F.xxhash64(docs[text]).alias("__t"))
    joined = work.join(gone, F.col("__d").eqNullSafe(F.col("__gd")) & (F.col("__t") == F.col("__gt")), "left")
    fields = joined.select(*columns, "__runs").schema
    place = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, longest, copies = [], [], [], []
            for value, runs in zip(batch.column(place), batch.column(len(columns))):
                kept, count, best = without_runs(value.as_py(), runs, min_words)
                texts.append(kept)
                counts.append(count)
                longest.append(best[0])
                copies.append(best[1])
            out = [batch.column(i) for i in range(len(columns))]
            out[place] = pa.array(texts, type=batch.column(place).type)
            out += [pa.array(c, type=pa.int64()) for c in (counts, longest, copies)]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, *added])

    from pyspark.sql import types as T

    schema = T.StructType([fields[c] for c in columns])
    for name in added:
        schema = schema.add(name, "long")
    return joined.select(*columns, "__runs").mapInArrow(run, schema)


def without_runs(text: str | None, runs: pa.ListScalar, min_words: int) -> tuple[str | None, int, tuple[int | None, int | None]]:
    """(what is left of a text, lines with words deleted, (lines, copies) of the longest run deleted)."""
    if not runs.is_valid:
        return text, 0, (None, None)
    line, size, copies = (runs.values.field(c).to_numpy() for c in ("line", "size", "copies"))
    parts = text.split("\n")
    words = np.array([len(SEPARATED.findall(p)) for p in parts])
    raw = np.flatnonzero(words)
    total = np.concatenate([[0], np.cumsum(words[raw])])
    enough = np.flatnonzero(total[line + size] - total[line] >= min_words)
    if not len(enough):
        return text, 0, (None, None)
    line, size, copies = line[enough], size[enough], copies[enough]
    change = np.zeros(len(parts) + 1, dtype=np.int64)
    np.add.at(change, raw[line], 1)
    np.add.at(change, raw[line + size - 1] + 1, -1)
    keep = np.cumsum(change[:-1]) == 0
    best = max(zip(size.tolist(), copies.tolist()))
    return "\n".join([p for p, k in zip(parts, keep) if k]), int(((words > 0) & ~keep).sum()), best
