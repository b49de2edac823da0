import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdictframe.llm import fill_in_middle as fim


@pytest.mark.parametrize("kind", ["sparse", "dense", "runs", "mixed", "empty", "full"])
def test_select_equals_the_sorted_members(kind):
    rng = np.random.default_rng(3)
    mask = {
        "sparse": lambda: rng.random(300_000) < 0.001,
        "dense": lambda: rng.random(300_000) < 0.5,
        "runs": lambda: np.repeat(rng.random(300) < 0.5, 1000),
        "mixed": lambda: np.concatenate([rng.random(70_000) < 0.5, np.zeros(200_000, bool), np.ones(70_000, bool), rng.random(70_000) < 0.01]),
        "empty": lambda: np.zeros(100, bool),
        "full": lambda: np.ones(65_537, bool),
    }[kind]()
    found = fim.BoundarySet(mask)
    members = np.flatnonzero(mask)
    assert len(found) == len(members)
    for k in {*rng.integers(0, max(len(members), 1), 200).tolist(), 0, len(members) - 1} if len(members) else ():
        assert found.select(k) == members[k]


def test_every_container_occurs():
    rng = np.random.default_rng(3)
    kinds = {type(fim.chunk_of(np.flatnonzero(m))) for m in (rng.random(60_000) < 0.001, rng.random(60_000) < 0.5, np.ones(60_000, bool))}
    assert kinds == {fim.ArrayChunk, fim.BitmapChunk, fim.RunChunk}


def plainly(text, key):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    h = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abZ<>PSM é\n", max_size=60)), st.integers(-5, 10**12))
def test_cut_equals_brute_force(text, key):
    assert fim.cut(text, str(key)) == plainly(text, str(key))


def test_operator(spark, docs_of):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice("ab <PSM>é\n7") for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [(1, rows[1][1]), (None, "one two"), (400, None), (401, ""), (402, "word, é " * 60_000), (403, "x" * 200_000)]
    rows += [(k, "<P<S<M and <P") for k in range(500, 540)]
    docs = docs_of(rows, extra=True).withColumn("form", F.lit("own"))
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    assert {"matches", "label"} <= set(out.columns) and out.columns.count("form") == 1
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.text or "", "" if r.doc_id is None else r.doc_id)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs_of([])).count() == 0
