import random

import pytest
from pyspark.sql import functions as F

from verdictframe.llm import shared


@pytest.mark.parametrize("edges", [
    [], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)], [(99, k) for k in range(40)] + [(5, 5), (7, 3), (3, 7)],
])
def test_components(spark, edges):
    rng = random.Random(1)
    edges = edges + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(35 if edges else 0)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in shared.components(df, "parts").collect()}
    joined = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in joined}


def test_bounded_sample_takes_the_smallest_hashes(spark):
    rows = spark.range(20_000)
    plain = {r["id"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(300).collect()}
    assert {r["id"] for r in shared.bounded_sample(rows, 300, "id").collect()} == plain
    assert shared.bounded_sample(rows.limit(50), 300, "id").count() == 50


def test_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(k * 7919 % 1000, "x") for k in range(1000)], "v long, t string").repartition(7)
    rows = shared.numbered(df, ["v"], "place", "numbers").orderBy("place").collect()
    assert [r["v"] for r in rows] == sorted(r["v"] for r in rows) and len({r["place"] for r in rows}) == 1000
