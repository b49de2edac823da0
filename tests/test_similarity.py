"""Similarity join, greedy removal and text matching against brute force."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdictframe.functions import charsim
from verdictframe.functions.gramindex import GramIndex
from verdictframe.operators import enrichment, similarity


def clustered(n, dim=8, seed=0, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = [(i, (centres[i % 5] + rng.normal(size=dim) * 0.35).tolist()) for i in range(n)]
    hot = rows[3][1]
    return rows + [(n + j, hot) for j in range(copies)]


def brute_pairs(rows, threshold, strict=False):
    out = []
    for a, x in rows:
        for b, y in rows:
            if a < b:
                s = float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))
                if s > threshold if strict else s >= threshold:
                    out.append((a, b, s))
    return out


def greedy(pairs, order):
    key = (lambda p: (-p[2], p[0], p[1])) if order == "similarity" else (lambda p: (p[0], p[1]))
    gone = set()
    for i, j, _ in sorted(pairs, key=key):
        if i not in gone and j not in gone:
            gone.add(j)
    return gone


@pytest.mark.parametrize("tile_rows", [4096, 37, 11])
@pytest.mark.parametrize("threshold", [0.85, 0.3])
def test_join_finds_every_pair(spark, tile_rows, threshold):
    rows = clustered(150)
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    got = similarity.similar_pairs(df, "id", "vec", threshold, tile_rows).collect()
    want = {(a, b): s for a, b, s in brute_pairs(rows, threshold)}
    assert len(got) == len(want)
    for r in got:
        assert r["similarity"] == pytest.approx(want[r["i"], r["j"]], abs=1e-9)


def test_hot_copies_are_a_star(spark):
    rows = clustered(40, copies=60)
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    stars = similarity.copy_pairs(df, "id", "vec").collect()
    assert {(r["i"], r["j"]) for r in stars} == {(3, j) for j in range(40, 100)}
    kept = {r["id"] for r in similarity.deduplicated(df, "id", "vec", 0.85, tile_rows=16).collect()}
    gone = greedy([(a, b, 1.0 if s > 1 - 1e-12 else s) for a, b, s in brute_pairs(rows, 0.85)], "similarity")
    assert kept == {a for a, _ in rows} - gone


@pytest.mark.parametrize("order", ["similarity", "index"])
@pytest.mark.parametrize("seed", range(4))
def test_removal_equals_the_greedy_pass(spark, order, seed):
    rng = random.Random(seed)
    n = 40
    pairs = [(i, j, rng.choice([0.5, 0.6, 0.7, rng.random()])) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.12]
    df = spark.createDataFrame(pairs, "i bigint, j bigint, similarity double")
    got = {r["removed"] for r in similarity.greedy_removed(df, order).collect()}
    assert got == greedy(pairs, order)


def test_removal_on_a_chain_and_a_hub(spark):
    chain = [(i, i + 1, 0.99 - i / 100) for i in range(9)]
    hub = [(100, 100 + j, 0.5 + j / 1000) for j in range(1, 60)]
    df = spark.createDataFrame(chain + hub, "i bigint, j bigint, similarity double")
    got = {r["removed"] for r in similarity.greedy_removed(df).collect()}
    assert got == greedy(chain + hub, "similarity")


def test_removal_with_cut_hubs(spark, monkeypatch):
    """A hub of most pairs, cut into parts: same result, no hot key in the join, one stored table per round."""
    rng = random.Random(9)
    pairs = [(0, j, 0.5 + rng.random() / 2) for j in range(1, 400)]
    pairs += [(i, j, rng.random()) for i in range(1, 60) for j in range(i + 1, 60) if rng.random() < 0.1]
    df = spark.createDataFrame(pairs, "i bigint, j bigint, similarity double")
    parts = {r["i"]: r["parts"] for r in similarity.hubs(df, 20).collect()}
    assert parts == {0: 20}
    stored = []
    monkeypatch.setattr(similarity, "truncate", lambda d, real=similarity.truncate: stored.append(real(d)) or stored[-1])
    got = {r["removed"] for r in similarity.greedy_removed(df, hub_edges=20).collect()}
    assert got == greedy(pairs, "similarity")
    sizes = [r["count"] for r in stored[2].groupBy("i", "part").count().collect()]
    assert max(sizes) < 60 and len(stored) <= 2 + 8


def test_removal_of_text_ids(spark):
    pairs = [(f"a{i}", f"b{j}", 0.9 - i / 100 - j / 1000) for i in range(5) for j in range(20)]
    df = spark.createDataFrame(pairs, "i string, j string, similarity double")
    assert {r["removed"] for r in similarity.greedy_removed(df, hub_edges=3).collect()} == greedy(pairs, "similarity")
    assert similarity.greedy_removed(df.limit(0)).count() == 0


def test_no_pairs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id bigint, vec array<double>")
    assert similarity.deduplicated(df, "id", "vec", 0.9).count() == 2


WORDS = ["tree", "array", "sort", "python", "react", "css", "graph", "zebra", "le", "và", "random"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "x1"]) for _ in range(n))


def make_questions(rng, n):
    return [(i, f"c{i % 3}", text(rng, rng.choice([3, 12, 60]))) for i in range(n)]


def make_resources(rng, n):
    rows = []
    for i in range(n):
        rows.append((
            i, rng.choice(enrichment.SOURCES), text(rng, 6), rng.randrange(9000), rng.randrange(80),
            [rng.choice(["Tree", "array", "css", "none"])], [rng.choice(["graph", "sort"])],
            rng.choice(["java", "python", "", "script"]), rng.choice(["a/tree", "acme/python", "x/y"]),
        ))
    return rows


def brute_resources(questions, resources, k, with_text):
    from verdictframe.functions import keywords as kw
    import re

    out = {}
    for uid, _, instruction in questions:
        low = instruction.lower()
        words = set(re.findall(r"\w+", low)) & set(kw.TECHNICAL_KEYWORDS)
        lang = next((n for n, ind in kw.LANGUAGE_INDICATORS.items() if any(x in low for x in ind)), "python")
        if not words:
            continue
        scored = []
        for rid, source, title, votes, answers, tags, topics, language, repo in resources:
            own = {"stackoverflow": tags, "official_docs": topics, "github_repo": repo.split("/")}[source]
            score = len(words & {w.lower() for w in own}) / len(words) * enrichment.KEYWORD_WEIGHT[source]
            if source == "stackoverflow":
                score += min(votes / 5000, 1) * 30 + min(answers / 50, 1) * 10
            elif source == "official_docs":
                score += 30 if language and language in lang else 0
            else:
                score += 30 if lang in repo.lower() else 0
            if with_text:
                score += enrichment.TEXT_WEIGHT[source] * SequenceMatcher(None, low[:100], title.lower()[:100]).ratio()
            if score > 0:
                scored.append((-score, rid))
        out[uid] = [(rid, -s) for s, rid in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("with_text", [False, True])
def test_resource_matching_equals_brute_force(spark, with_text):
    rng = random.Random(11)
    questions, resources = make_questions(rng, 25), make_resources(rng, 90)
    q = spark.createDataFrame(questions, "uid bigint, category string, instruction string")
    r = spark.createDataFrame(
        resources, "rid bigint, source string, title string, votes bigint, answer_count bigint, "
        "tags array<string>, topics array<string>, language string, repo string")
    if with_text:
        got = enrichment.match_resources_by_text(q, r, 5, first_read=8)
    else:
        got = enrichment.match_resources(q, r, 5)
    rows = {}
    for row in got.orderBy("uid", "rank").collect():
        rows.setdefault(row["uid"], []).append((row["rid"], row["score"]))
    want = brute_resources(questions, resources, 5, with_text)
    assert set(rows) == {u for u, v in want.items() if v}
    for uid, found in rows.items():
        assert [s for _, s in found] == pytest.approx([s for _, s in want[uid]], abs=1e-9)
        assert [i for i, _ in found] == [i for i, _ in want[uid]]


def test_issue_matching_equals_brute_force(spark):
    rng = random.Random(5)
    questions = make_questions(rng, 12)
    issues = [(i, f"c{i % 4}", text(rng, rng.choice([1, 20, 70]))) for i in range(60)] + [(60, "c0", "")]
    q = spark.createDataFrame(questions, "uid bigint, category string, instruction string")
    s = spark.createDataFrame(issues, "rid bigint, category string, instruction string")
    got = {}
    for row in enrichment.match_issues(q, s, 3, question_bytes=2000, index_rows=7).orderBy("uid", "rank").collect():
        got.setdefault(row["uid"], []).append((row["rid"], row["score"]))
    for uid, category, instruction in questions:
        scored = []
        for rid, other, body in issues:
            a, b = instruction.lower()[:200], body.lower()[:200]
            ratio = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            scored.append((-(1.5 if other == category else 0.5) * ratio, other != category, rid))
        best = sorted(scored)[:3]
        assert [s for _, s in got[uid]] == pytest.approx([-x for x, *_ in best], abs=1e-9)
        assert [r for r, _ in got[uid]] == [r for *_, r in best]


def test_matching_characters_equal_the_definition():
    """Against the standard library's matcher, with and without popular characters."""
    rng = random.Random(1)
    alphabets = ["ab", "abcdefgh é", "abcdefghijklmnopqrstuvwxyz .,0123"]
    for trial in range(300):
        letters = alphabets[trial % 3]
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 20, 100, 200])))
        b = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 199, 200, 210, 260]))) for _ in range(6)]
        b[0] = (a[: len(a) // 2] + b[0])[:230]
        want = [SequenceMatcher(None, a, t).ratio() if a and t else 0.0 for t in b]
        assert charsim.ratios(a, b).tolist() == want
    long = ["xy" * 40_000, "x" * 70_000 + "yx"]
    assert charsim.ratios("xyx", long).tolist() == [SequenceMatcher(None, "xyx", t).ratio() for t in long]


def test_bounds_of_the_lists_are_never_too_small():
    rng = random.Random(9)
    for trial in range(60):
        letters = "etaoinshrdlu cmfwyp" if trial % 2 else "abcdefgh"
        b = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 150, 200, 230, 400]))) for _ in range(20)]
        a = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 100, 200, 300])))
        b[0], b[1] = (a * 3)[:230], b[2][:50] + a[:100] + b[3][:100]
        index, codes = GramIndex(b), charsim.codes_of([a])[0]
        found = index.matched(codes, np.array([0, len(codes)]), np.zeros(len(b), dtype=np.int64), np.arange(len(b)))
        assert found.tolist() == [sum(m.size for m in SequenceMatcher(None, a, t).get_matching_blocks()) for t in b]
        assert (index.bounds_of(codes) >= found).all()
        flat, bounds = charsim.codes_of(b)
        assert (charsim.shared(codes, np.array([0, len(codes)]), np.zeros(len(b), dtype=np.int64), flat, bounds) >= found).all()


def test_tried_pairs_grow_far_slower_than_all_pairs(spark):
    from verdictframe.plans.enrichment import issue_table
    from verdictframe.sources.views import view

    tried, pairs = [], []
    for sf in ("0.01", "0.1"):
        questions, issues = view(spark, f"/root/testdata/sf{sf}", "questions"), issue_table(spark, f"/root/testdata/sf{sf}")
        count = spark.sparkContext.accumulator(0)
        assert enrichment.match_issues(questions, issues, tried=count).count() == 3 * questions.count()
        tried.append(count.value)
        pairs.append(questions.count() * issues.count())
    assert tried[1] < 0.05 * pairs[1] and tried[1] / tried[0] < pairs[1] / pairs[0] / 2, (tried, pairs)


def test_resource_lists_are_read_in_part(spark):
    from verdictframe.plans.enrichment import resources
    from verdictframe.sources.views import view

    sf = "/root/testdata/sf0.1"
    asked, table = view(spark, sf, "questions"), resources(spark, sf)
    top = enrichment.match_resources_by_text(asked, table)
    floors = top.filter("rank = 5").select("uid", F.col("score").alias("floor"))
    asked = enrichment.question_signatures(asked).join(floors, "uid").withColumn("q_text", F.lit(""))
    read = enrichment.resource_candidates(asked, enrichment.resource_features(table)).count()
    assert read < 0.1 * asked.count() * table.count()


def test_a_few_long_texts_are_not_broadcast(spark):
    from verdictframe.session import broadcast_if_small

    few = spark.createDataFrame([(k, "x" * 1000) for k in range(50)], "k int, t string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(few, 50)) and not hinted(broadcast_if_small(few, 49))
    assert not hinted(broadcast_if_small(few, 50, max_bytes=49_000))


def test_a_tile_is_bounded_whatever_is_asked(spark, monkeypatch):
    """Larger tiles than the bound are cut, and no task holds more than tile x chunk."""
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 6)))]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    whole = sorted(tuple(r) for r in similarity.similar_pairs(df, "id", "vec", 0.8).select("i", "j").collect())
    monkeypatch.setattr(similarity, "TILE_ROWS", 40)
    monkeypatch.setattr(similarity, "ROWS_AT_ONCE", 7)
    cut = similarity.similar_pairs(df, "id", "vec", 0.8, tile_rows=10_000)
    assert sorted(tuple(r) for r in cut.select("i", "j").collect()) == whole and whole
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(targets" in plan


def test_every_pair_of_copies_is_listed(spark):
    """Rows pair as in the SQL join: copies with each other and with all that match, repeated rows as often as they come."""
    rows = clustered(60, copies=25)
    rows += [(7, rows[7][1]), (200, None), (None, rows[5][1]), (201, [2 * x for x in rows[3][1]])]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    want = sorted((a, b) for a, b, s in brute_pairs([r for r in rows if None not in r], 0.85))
    for tile_rows in (4096, 9):
        got = similarity.similar_pairs(df, "id", "vec", 0.85, tile_rows).collect()
        assert sorted((r["i"], r["j"]) for r in got) == want
        assert all(r["similarity"] == 1.0 for r in got if {r["i"], r["j"]} <= {3, *range(60, 85)})
    # At 1 the copies are there, too.
    exact = similarity.similar_pairs(df, "id", "vec", 1.0).collect()
    assert {(r["i"], r["j"]) for r in exact} >= {(3, j) for j in range(60, 85)} | {(60, 84)}


def test_tiles_are_stored_once_and_travel_by_parts(spark, monkeypatch):
    """A tile is one row, and goes to a few parts instead of every tile it meets."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 6)))], "id bigint, vec array<float>")
    stored = []
    monkeypatch.setattr(similarity, "truncate", lambda d, real=similarity.truncate: stored.append(real(d)) or stored[-1])
    plan = similarity.similar_pairs(df, "id", "vec", 0.3, 20)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "CoGroup" not in plan
    assert max(map(int, re.findall(r"hashpartitioning\(left#\d+, right#\d+, (\d+)\)", plan))) <= 4 * 36
    tiles = stored[-1].collect()
    assert len(tiles) >= 20 and sum(len(r["data"]) for r in tiles) == 400 * 6 * 4
    assert max(len(r["ids"]) for r in tiles) < 60


@pytest.mark.parametrize("order", ["similarity", "index"])
def test_removal_in_bands_and_heads_equals_the_greedy_pass(spark, monkeypatch, order):
    """Few pairs in a band, few rows in a head: same survivors, and no step stores all pairs."""
    rows = clustered(160, seed=4)
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    strict = order == "index"
    pairs = brute_pairs(rows, 0.3, strict)
    monkeypatch.setattr(similarity, "EDGES_AT_ONCE", 300)
    monkeypatch.setattr(similarity, "HEAD_BYTES", 8 * 8 * 13)
    bands, kept = [], None
    monkeypatch.setattr(similarity, "greedy_removed", lambda p, *a, real=similarity.greedy_removed, **k: bands.append(p.count()) or real(p, *a, **k))
    kept = {r["id"] for r in similarity.deduplicated(df, "id", "vec", 0.3, order=order, tile_rows=64).collect()}
    assert kept == {a for a, _ in rows} - greedy(pairs, order)
    assert len(bands) > 2 and max(bands) < len(pairs) / 2 if order == "similarity" else not bands


def test_rows_without_a_vector_stay(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, None)], "id bigint, vec array<double>")
    for order in ("similarity", "index"):
        assert sorted(r["id"] for r in similarity.deduplicated(df, "id", "vec", 0.9, order=order).collect()) == [1, 3, 4]
