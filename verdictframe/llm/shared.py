"""Helpers of the operators that work in several Spark steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdictframe.session import shared_dir


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read again: lineage ends, lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, columns: list[str], name: str, folder: str) -> DataFrame:
    """Adds a number that grows with the order of the columns; gaps occur between partitions.

    Rows are dealt out by ranges, sorted there and numbered by partition and place; the result
    is stored, so the numbers never change.
    """
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return stored(ranged.withColumn(name, F.monotonically_increasing_id()), folder)


def bounded_sample(rows: DataFrame, limit: int, *keys: str) -> DataFrame:
    """The ``limit`` rows with the smallest hash of the keys, ties by the keys.

    Of many rows a bound on the hash first leaves somewhat more than ``limit`` in all; else
    every task would send that many to the one that merges them.
    """
    place = F.xxhash64(*keys)
    total = rows.count()
    wanted = 2 * limit + 200
    if total > wanted:
        rows = rows.filter(place < -(1 << 63) + (wanted << 64) // total)
    return rows.orderBy(place, *keys).limit(limit)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of equal values in the first ``keys`` columns (numbers) of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if held and last != tuple(values[a].tolist()):
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(values[a].tolist())
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): the smallest node of the component of every node in the edges (a, b).

    Alternating star contraction: every node hangs its larger neighbours on its smallest
    one, then its smaller ones. Minima are aggregated before they are joined back, so a
    hub costs no more than its edges; each round is stored.
    """
    edges = stored(_clean(edges), folder)
    before = None
    while True:
        edges = _star(_star(edges, large=True), large=False)
        edges = stored(_clean(edges), folder)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(roots)


def _clean(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    )


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` have a < b. Large: larger neighbours of a node move to its minimum; small: the smaller ones do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    if large:
        moved = edges.join(lowest, "a").select(F.col("low").alias("a"), "b")
        return moved
    lowest = edges.groupBy("b").agg(F.min("a").alias("low"))
    joined = edges.join(lowest, "b")
    return joined.select(F.col("low").alias("a"), F.col("a").alias("b")).unionByName(
        lowest.select(F.col("low").alias("a"), "b")
    )


def broadcast_within(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if ``df`` (of fixed-width columns) has at most ``rows`` rows, else ``df``."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

