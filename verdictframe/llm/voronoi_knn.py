"""Exact top-k by integer inner product as a Voronoi kNN join.

Vectors are cut to whole numbers, floor(SCALE * x). Pivots, a bounded sample of the vectors, cut
the space into cells: a vector belongs to its nearest pivot. Each cell is summed up by
its size, its radius and the distances of its members nearest to the pivot. From the summaries alone
every query gets a lower bound of its k-th best score: q.x >= q.p - |q| |x - p|. A cell goes on
only if its upper bound q.p + |q| radius reaches that, so a query is copied to the cells that may hold a
result and to no other. A cell of many members is cut into parts of bounded size. Each
(cell, part) is solved locally by one matrix product, and the best k per query
of the parts are merged.

Defined results: vectors null, empty or holding null or non-finite components take no part, as query or as
candidate; a query's own row is no candidate; equal scores go to the smaller id; fewer candidates give
fewer rows; vectors of another length than the first pivot's compare as if padded with zeros;
repeated rows (same id) are candidates each, but none for a query of their id, and ask once, with the largest vector; null
ids take no part. Scores are exact while they fit a 64-bit integer, whatever the size of the components; a component beyond
64 bits stops the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.shared import bounded_sample, stored

SCALE = 256
#: Cells, and the rows of a part of a cell.
PIVOTS = 128
PART = 4_096
#: Pairs of a query and a part that are multiplied at once.
QUERIES_AT_ONCE = 512


def whole_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): usable vectors as arrays of long."""
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(usable)
    rows = rows.filter(F.col("id").isNotNull()).select("id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("v"))
    return rows


def matrix(column: pa.Array, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a list column as numbers of a kind, cut or padded to ``width``."""
    cut = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(kind)
    size = np.diff(cut)
    if len(size) and (size == width).all():
        return flat[cut[0] : cut[-1]].reshape(-1, width)
    out = np.zeros((len(size), width), dtype=kind)
    for k, (a, b) in enumerate(zip(cut, cut[1:])):
        out[k, : min(b - a, width)] = flat[a : min(b, a + width)]
    return out


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot (``cell``, the first of equals) and the distance to it to (id, v, row)."""
    width = pivots.shape[1]
    square = (pivots**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            own = (x**2).sum(axis=1)
            apart = own[:, None] - 2 * (x @ pivots.T) + square
            cell = apart.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(cell.astype(np.int32)),
                 pa.array(np.sqrt(np.maximum(apart[np.arange(len(x)), cell], 0.0)))],
                names=["id", "v", "row", "cell", "far"],
            )

    return rows.select("id", "v", "row").mapInArrow(run, "id long, v array<long>, row long, cell int, far double")


def summaries(cells: DataFrame, k: int) -> DataFrame:
    """Per cell: members, radius and the k + 1 smallest distances to the pivot."""
    near = Window.partitionBy("cell").orderBy("far", "row")
    nearest = (
        cells.select("cell", "far", "row").withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k + 1)
        .groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("nearest"))
    )
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.max("far").alias("radius"))
    return sizes.join(nearest, "cell")


def routed(queries: DataFrame, summary: list, pivots: np.ndarray, k: int) -> DataFrame:
    """Copies of the queries for every part of every cell that may hold one of their k best."""
    number = np.array([r["cell"] for r in summary], dtype=np.int64)
    members = np.array([r["members"] for r in summary], dtype=np.int64)
    radius = np.array([r["radius"] for r in summary])
    parts = -(-members // PART)
    near_cell = np.repeat(np.arange(len(summary)), [len(r["nearest"]) for r in summary])
    near = np.concatenate([r["nearest"] for r in summary]) if summary else np.zeros(0)
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch.column(1), width)
            if not len(q):
                continue
            size = np.sqrt((q**2).sum(axis=1))
            middle = q @ pivots[number].T
            # the k + 1 best lower bounds leave k once the query itself is out; floats are given room
            low = middle[:, near_cell] - size[:, None] * near
            kth = low.shape[1] - (k + 1)
            least = np.partition(low, kth, axis=1)[:, kth] if kth >= 0 else np.full(len(q), -np.inf)
            room = 1e-6 * (1 + size * (radius.max() + np.sqrt((pivots**2).sum(axis=1)).max()))
            go = middle + size[:, None] * radius >= (least - room)[:, None]
            row, cell = np.nonzero(go)
            count = parts[cell]
            row, cell = np.repeat(row, count), np.repeat(cell, count)
            part = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number[cell].astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.ones(len(row), dtype=np.int32)),
                 batch.column(0).take(at), batch.column(1).take(at)],
                names=["cell", "part", "asks", "id", "v"],
            )

    return queries.mapInArrow(run, "cell int, part int, asks int, id long, v array<long>")


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exactly: in floating point while every sum stays below 2**53, else in integers."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, ties to the smaller id; ids are sorted."""
    falling = ~score  # falls where the score rises, over all integers
    if score.shape[1] <= k:
        return np.argsort(falling, axis=1, kind="stable")
    bound = np.partition(falling, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(score), k), dtype=np.int64)
    for r in range(len(score)):
        hits = np.flatnonzero(falling[r] <= bound[r])
        out[r] = hits[np.argsort(falling[r, hits], kind="stable")[:k]]
    return out


def solve(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """Rows of a (cell, part): first its members, then its queries. Queries stream, members are held."""
    held, x, ids, last = [], None, None, None
    for batch in batches:
        cells, part, asks = (batch.column(c).to_numpy() for c in range(3))
        change = np.flatnonzero((cells[1:] != cells[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            place = (int(cells[a]), int(part[a]))
            if place != last:
                held, x, last = [], None, place
            rows = batch.slice(a, b - a)
            if not asks[a]:
                held.append(rows)
                x = None
                continue
            if x is None:
                if not held:
                    continue
                x = np.concatenate([matrix(h.column(4), width, np.int64) for h in held])
                ids = np.concatenate([h.column(3).to_numpy() for h in held])
                order = np.argsort(ids, kind="stable")
                x, ids = x[order], ids[order]
            q, asker = matrix(rows.column(4), width, np.int64), rows.column(3).to_numpy()
            for s in range(0, len(q), QUERIES_AT_ONCE):
                score = products(q[s : s + QUERIES_AT_ONCE], x)
                own = asker[s : s + QUERIES_AT_ONCE]
                mine = own[:, None] == ids
                score[mine] = np.iinfo(np.int64).min
                top = best(score, ids, k)
                value = np.take_along_axis(score, top, axis=1)
                good = ~np.take_along_axis(mine, top, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, good.sum(axis=1))), pa.array(ids[top[good]]), pa.array(value[good])],
                    names=["query_id", "vec_id", "score"],
                )


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for every row of ``queries``."""
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, key, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sample = bounded_sample(rows, PIVOTS, "row").select("v").distinct().orderBy("v").collect()
    empty = "query_id long, rank int, vec_id long, score long"
    if not sample:
        return spark.createDataFrame([], empty)
    width = max(len(r["v"]) for r in sample)
    width = max(width, rows.agg(F.max(F.size("v"))).first()[0])
    pivots = np.zeros((len(sample), width))
    for at, r in enumerate(sample):
        pivots[at, : len(r["v"])] = r["v"]
    cells = stored(in_cells(rows, pivots), "cells")
    summary = summaries(cells, k).orderBy("cell").collect()  # PIVOTS rows
    asking = whole_vectors(queries, key, vector).groupBy("id").agg(F.max("v").alias("v"))
    asked = routed(asking, summary, pivots, k)
    parts = F.element_at(
        F.create_map(*[F.lit(x) for r in summary for x in (r["cell"], int(-(-r["members"] // PART)))]), F.col("cell")
    )
    members = cells.select(
        "cell", F.pmod(F.xxhash64("row"), parts).cast("int").alias("part"), F.lit(0).alias("asks"), "id", "v"
    )
    dealt = members.unionByName(asked).repartition("cell", "part").sortWithinPartitions("cell", "part", "asks")
    found = dealt.mapInArrow(lambda batches: solve(batches, k, width), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


