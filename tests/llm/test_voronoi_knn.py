import numpy as np
import pytest

from verdictframe.llm import voronoi_knn


def brute(rows, queries, k):
    width = max((len(v) for v in rows.values()), default=1)
    ids = np.array(sorted(rows))
    x = np.zeros((len(ids), width))
    for at, i in enumerate(ids):
        x[at, : len(rows[i])] = np.floor(np.array(rows[i], dtype=np.float32).astype(float) * 256)
    out = set()
    for at, i in enumerate(ids):
        if i in queries:
            score = x @ x[at]
            score[at] = -np.inf
            order = [j for j in np.lexsort((ids, -score)) if j != at][:k]
            out |= {(int(i), r + 1, int(ids[j]), int(score[j])) for r, j in enumerate(order)}
    return out


def run(spark, rows, step, k=5):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    return {tuple(r) for r in voronoi_knn.top_k(df, df.filter(f"vec_id % {step} = 0"), k).collect()}


@pytest.mark.parametrize("part, pivots", [(4096, 128), (40, 8), (4096, 1)])
def test_against_all_pairs(spark, monkeypatch, part, pivots):
    monkeypatch.setattr(voronoi_knn, "PART", part)
    monkeypatch.setattr(voronoi_knn, "PIVOTS", pivots)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    rows = {i: (centres[i % 6] + rng.normal(size=16) * 0.3).tolist() for i in range(400)}
    rows.update({1000 + i: rows[0] for i in range(150)})  # one common vector, ties
    assert run(spark, list(rows.items()), 10) == brute(rows, {i for i in rows if i % 10 == 0}, 5)


def test_bounds_leave_out_far_cells(spark, monkeypatch):
    """Well separated clusters: most copies of the queries are saved."""
    rng = np.random.default_rng(2)
    pivots = np.eye(8) * 1000
    rows = [(i, (pivots[i % 8] + rng.integers(-3, 3, 8)).astype(int).tolist()) for i in range(800)]
    df = spark.createDataFrame([(*r, r[0]) for r in rows], "id long, v array<long>, row long")
    cells = voronoi_knn.in_cells(df, pivots)
    summary = voronoi_knn.summaries(cells, 5).orderBy("cell").collect()
    routed = voronoi_knn.routed(df.filter("id < 80"), summary, pivots, 5)
    assert routed.count() == 80


def test_defined_results(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (10, [0.5, 0.5]), (1, None), (20, [1.0, None]), (30, [nan, 1.0]), (40, [inf, 0.0]), (50, []), (3, [0.25, 0.0]), (None, [1.0, 1.0]), (3, [0.25, 0.0])]
    usable = {0: [1.0, 0.0], 10: [0.5, 0.5], 3: [0.25, 0.0]}
    both = brute(usable, {0, 10}, 5) | {(0, 3, 3, 16384), (10, 3, 3, 8192)}  # row 3 stands there twice
    assert run(spark, rows, 10) == both
    assert run(spark, [(0, [1.0])], 1) == set()
    assert run(spark, [], 1) == set() and run(spark, [(1, None)], 1) == set()
    assert run(spark, [(0, [1.0, 2.0, 3.0]), (1, [1.0]), (2, [2.0, 2.0])], 1) == brute({0: [1.0, 2.0, 3.0], 1: [1.0], 2: [2.0, 2.0]}, {0, 1, 2}, 5)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    vectors = {i: (400_000.37 + rng.normal(size=12)).tolist() for i in range(60)}
    vectors |= {100 + i: (rng.normal(size=12) * 1e6).tolist() for i in range(40)}
    cut = {i: [int(np.floor(256 * float(np.float32(c)))) for c in v] for i, v in vectors.items()}
    want = set()
    for i in range(0, 140, 10):
        if i in cut:
            scores = sorted((-sum(a * b for a, b in zip(cut[i], cut[j])), j) for j in cut if j != i)[:5]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    assert run(spark, list(vectors.items()), 10) == want
    big = np.array([[2**31, -(2**30)], [3, 5]], dtype=np.int64)
    assert voronoi_knn.products(big, big).tolist() == [[2**62 + 2**60, 3 * 2**31 - 5 * 2**30], [3 * 2**31 - 5 * 2**30, 34]]
