"""Ratings against plain loops and against each other."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdictframe.functions import draws, pairfit
from verdictframe.operators import battles as battle_ops
from verdictframe.operators import correlate, leaderboard, ratings


def random_battles(n, models=6, seed=1, systems=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n * systems):
        a, b = rng.sample(range(models), 2)
        p = 1 / (1 + math.exp(-(a - b) / 2))
        u = rng.random()
        vote = "vote_tie" if u < 0.15 else "vote_left" if rng.random() < p else "vote_right"
        rows.append((f"s{i % systems}", i * 7 + 3, f"m{a}", f"m{b}", vote))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "system string, seq bigint, model_a string, model_b string, vote string")


def plain_elo(rows, k=4, scale=400, base=10, init=1000):
    rating = {}
    for _, _, a, b, vote in sorted(rows, key=lambda r: r[1]):
        ra, rb = rating.setdefault(a, init), rating.setdefault(b, init)
        ea, eb = 1 / (1 + base ** ((rb - ra) / scale)), 1 / (1 + base ** ((ra - rb) / scale))
        s = {"vote_left": 1, "vote_right": 0}.get(vote, 0.5)
        rating[a] += k * (s - ea)
        rating[b] += k * (1 - s - eb)
    return rating


@pytest.mark.parametrize("rows_per_chunk", [10_000, 40, 7])
def test_elo_equals_the_loop_for_any_chunking(spark, rows_per_chunk):
    rows = random_battles(120, systems=2)
    out = ratings.online_elo(frame(spark, rows), ["system"], rows_per_chunk=rows_per_chunk).collect()
    got = {(r["system"], r["model"]): r["rating"] for r in out}
    for system in ("s0", "s1"):
        for model, value in plain_elo([r for r in rows if r[0] == system]).items():
            assert got[system, model] == pytest.approx(value, abs=1e-9)


def test_elo_self_pair_and_continuation(spark):
    rows = [("s0", 1, "x", "x", "vote_left"), ("s0", 2, "x", "y", "vote_right"), ("s0", 3, "y", "z", "vote_tie")]
    whole = {r["model"]: r["rating"] for r in ratings.online_elo(frame(spark, rows), ["system"]).collect()}
    for model, value in plain_elo(rows).items():
        assert whole[model] == pytest.approx(value, abs=1e-9)
    first = ratings.online_elo(frame(spark, rows[:2]), ["system"])
    both = ratings.online_elo(frame(spark, rows[2:]), ["system"], start=first)
    assert {r["model"]: r["rating"] for r in both.collect()} == pytest.approx(whole)


def test_bounds_follow_order_statistics(spark):
    rows = [(m, i, float(i * 3 % 101)) for m in ("a", "b") for i in range(100)]
    df = spark.createDataFrame(rows, "model string, replicate int, rating double")
    out = {r["model"]: r for r in ratings.bootstrap_bounds(df, [], 100, 0.9).collect()}
    ordered = sorted(r[2] for r in rows if r[0] == "a")
    alpha = (1 - 0.9) / 2
    assert out["a"]["lower_bound"] == ordered[int(alpha * 100)]
    assert out["a"]["upper_bound"] == ordered[int((1 - alpha) * 100)]


def test_bradley_terry_gradient_and_centre(spark):
    counts = battle_ops.pair_outcomes(frame(spark, random_battles(400)), [])
    fit = {r["model"]: r["coef"] for r in ratings.fit_pairs(counts, []).collect()}
    assert sum(fit.values()) == pytest.approx(0, abs=1e-8)
    slope = dict.fromkeys(fit, 0.0)
    for r in counts.collect():
        n = r["a_win"] + r["b_win"] + r["tie"]
        gap = r["a_win"] + r["tie"] / 2 - n / (1 + math.exp(fit[r["model_b"]] - fit[r["model_a"]]))
        slope[r["model_a"]] += gap
        slope[r["model_b"]] -= gap
    assert max(map(abs, slope.values())) < 1e-6


def test_bradley_terry_components_and_edge_cases():
    pairs = pd.DataFrame({
        "model_a": ["a", "c"], "model_b": ["b", "d"], "a_win": [3, 1], "b_win": [1, 2], "tie": [0, 2],
    })
    fit = ratings.bradley_terry_fit(pairs).set_index("model")["coef"]
    assert fit["a"] + fit["b"] == pytest.approx(0) and fit["c"] + fit["d"] == pytest.approx(0)
    assert fit["a"] - fit["b"] == pytest.approx(math.log(3))
    one_sided = pairs.assign(b_win=0, tie=0)
    assert (ratings.bradley_terry_fit(one_sided)["coef"] == 0).all()
    separated = pd.DataFrame({"model_a": ["a", "b"], "model_b": ["b", "c"], "a_win": [5, 1], "b_win": [0, 1], "tie": [0, 0]})
    out = ratings.bradley_terry_fit(separated)
    assert not out["converged"].any() and out["coef"].abs().max() <= 30


def test_legacy_ties_take_the_later_orientation():
    pairs = pd.DataFrame({
        "model_a": ["a", "b"], "model_b": ["b", "a"], "a_win": [4, 1], "b_win": [1, 0], "tie": [6, 2],
    })
    added = ratings.bradley_terry_fit(pairs).set_index("model")["coef"]
    legacy = ratings.bradley_terry_fit(pairs, legacy_ties=True).set_index("model")["coef"]
    # a's wins: 4 of a-b, 0 of b-a; b's: 1 + 1; ties count half for each.
    assert added["a"] - added["b"] == pytest.approx(math.log((4 + 4) / (2 + 4)))
    assert legacy["a"] - legacy["b"] == pytest.approx(math.log((4 + 1) / (2 + 1)))


def test_rao_kupper_is_a_maximum():
    rng = np.random.default_rng(5)
    left, right = np.array([0, 0, 1]), np.array([1, 2, 2])
    a_win, b_win, tie = (rng.integers(5, 40, 3).astype(float) for _ in range(3))
    coef, eta, ok = pairfit.fit_rao_kupper(left, right, a_win, b_win, tie, 3)
    assert ok

    def loss(c, e):
        d = c[left] - c[right]
        pw, pl = pairfit.sigmoid(d - e), pairfit.sigmoid(-d - e)
        return -(a_win * np.log(pw) + b_win * np.log(pl) + tie * np.log(1 - pw - pl)).sum()

    best = loss(coef, eta)
    for _ in range(200):
        assert loss(coef + rng.normal(0, 0.02, 3), eta + rng.normal(0, 0.02)) >= best - 1e-9


def test_count_resampling_agrees_with_row_resampling(spark):
    rows = random_battles(300, models=4)
    counts = battle_ops.pair_outcomes(frame(spark, rows), [])
    fits = ratings.bootstrap_fits(counts, [], rounds=200).toPandas()
    rng = np.random.default_rng(3)
    by_rows = []
    table = pd.DataFrame(rows, columns=["system", "seq", "model_a", "model_b", "vote"])
    for _ in range(200):
        s = table.sample(len(table), replace=True, random_state=rng)
        cells = s.groupby(["model_a", "model_b"])["vote"].agg(
            a_win=lambda v: (v == "vote_left").sum(), b_win=lambda v: (v == "vote_right").sum(),
            tie=lambda v: (v == "vote_tie").sum()).reset_index()
        by_rows.append(ratings.bradley_terry_fit(cells).set_index("model")["coef"])
    spread = pd.concat(by_rows, axis=1).std(axis=1)
    ours = fits.groupby("model")["coef"].std()
    assert ((ours / spread) - 1).abs().max() < 0.3


def test_leaderboard_methods_agree(spark):
    rng = random.Random(2)
    rows = [("m1" if i % 3 else "m2", rng.choice([0.0, 0.5, 1.0, 1.0])) for i in range(900)]
    cells = leaderboard.score_cells(spark.createDataFrame(rows, "model string, score double"))
    a = leaderboard.bootstrap_means(cells, 400).toPandas().groupby("model")["mean"]
    b = leaderboard.bootstrap_means_by_draws(cells, 400).toPandas().groupby("model")["mean"]
    assert (a.mean() - b.mean()).abs().max() < 0.01
    assert (a.std() / b.std() - 1).abs().max() < 0.25


def test_leaderboard_baseline_and_unknown_label(spark):
    games = spark.createDataFrame(
        [("u", "m", "t", "A>>B", "B>A"), ("v", "m", "t", "??", "A=B")],
        "uid string, model string, topic string, score1 string, score2 string")
    scores = [r["score"] for r in leaderboard.score_rows(games, "score1", "score2").orderBy("uid").collect()]
    assert sorted(scores, key=str) == sorted([0.0, 0.0, 0.0, 0.0, 0.5, None], key=str)
    cells = leaderboard.score_cells(leaderboard.score_rows(games, "score1", "score2"))
    board = {r["model"]: r for r in leaderboard.leaderboard(leaderboard.bootstrap_means(cells), "base").collect()}
    assert board["base"]["score_pct"] == 50.0 and board["base"]["ci_low"] == 0.0


@pytest.mark.parametrize("r,n,p", [(0.5, 10, 0.1411), (0.9, 5, 0.0374), (-0.3, 20, 0.1987), (1.0, 4, 0.0), (0.0, 8, 1.0)])
def test_p_values_match_tables(r, n, p):
    assert pairfit.correlation_p_value(r, n) == pytest.approx(p, abs=2e-4)


def test_correlation_needs_three_models(spark):
    rows = [(s, m, float(i)) for s in ("x", "y") for i, m in enumerate("ab")]
    df = spark.createDataFrame(rows, "system string, model string, rating double")
    out = correlate.correlations(correlate.system_pairs(df)).first()
    assert out["correlation"] is None and out["p_value"] is None and not out["significant"]


@pytest.mark.parametrize("bucket", [3, 50, 10_000])
def test_dense_index_is_contiguous(spark, bucket):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else f"k{i % 5}", v) for i, v in enumerate(rng.sample(range(10**6), 400))]
    out = draws.dense_index(spark.createDataFrame(rows, "k string, v bigint"), ["k"], "v", "i", "n", bucket).collect()
    by_key = {}
    for r in out:
        by_key.setdefault(r["k"], []).append((r["v"], r["i"], r["n"]))
    for items in by_key.values():
        items.sort()
        assert [i for _, i, _ in items] == list(range(len(items)))
        assert {n for *_, n in items} == {len(items)}


def test_binary_fit_agrees_with_newton(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(600):
        x, z = rng.choice([0.0, 0.5, 1.0]), rng.choice([0.0, 1.0])
        rows.append((1.0 if rng.random() < 1 / (1 + math.exp(-(x - z))) else 0.0, x, z))
    df = spark.createDataFrame(rows, "won double, x double, z double")
    model = ratings.fit_binary(ratings.binary_cells(df, ["x", "z"], "won"), ["x", "z"], "won", "weight")
    w = np.append(model.coefficients.toArray(), model.intercept)
    data = np.array(rows)
    design = np.column_stack([data[:, 1:], np.ones(len(data))])
    grad = design.T @ (data[:, 0] - pairfit.sigmoid(design @ w)) - np.append(w[:2], 0)
    assert np.abs(grad).max() < 1e-2
    means = {r["feature"]: r["m"] for r in ratings.bootstrap_binary(df, ["x", "z"], "won", 60).groupBy("feature").agg(F.avg("coef").alias("m")).collect()}
    assert means["x"] == pytest.approx(w[0], abs=0.15)
    # The draws belong to the cells, so another split of the rows changes nothing.
    ours = {(r["replicate"], r["feature"]): r["coef"] for r in ratings.bootstrap_binary(df.repartition(1), ["x", "z"], "won", 5).collect()}
    other = {(r["replicate"], r["feature"]): r["coef"] for r in ratings.bootstrap_binary(df.repartition(7, "x"), ["x", "z"], "won", 5).collect()}
    assert ours.keys() == other.keys() and all(ours[k] == pytest.approx(other[k], abs=1e-7) for k in ours)


def test_elo_chunks_hold_no_more_than_their_rows(spark):
    """Keys that follow one another in time: the chunk bound holds for each of them."""
    rng = random.Random(4)
    rows = [(f"s{s}", s * 400 + i, *rng.sample(["a", "b", "c", "d"], 2), rng.choice(["vote_left", "vote_right", "vote_tie"]))
            for s in range(5) for i in range(400)]
    df = frame(spark, rows)
    whole = {(r["system"], r["model"]): r["rating"] for r in ratings.online_elo(df, ["system"]).collect()}
    cut = {(r["system"], r["model"]): r["rating"] for r in ratings.online_elo(df, ["system"], rows_per_chunk=90).collect()}
    assert whole.keys() == cut.keys() and all(cut[k] == pytest.approx(whole[k]) for k in whole)
    place = ratings.dense_index(df, ["system"], "seq", "_place", rows_per_bucket=90)
    sizes = place.groupBy("system", F.floor(F.col("_place") / 90)).count()
    assert sizes.agg(F.max("count")).first()[0] <= 90


def test_a_pool_of_one_model_meets_itself(spark):
    from verdictframe.operators import worklist

    prompts = spark.range(5).withColumnRenamed("id", "prompt")
    models = spark.sql("SELECT 'only' model, 1.0D weight, false outage, false boost, false anonymous, CAST(NULL AS ARRAY<STRING>) strict, CAST(NULL AS ARRAY<STRING>) targets")
    out = worklist.battle_pairs(prompts, models, "prompt").collect()
    assert len(out) == 5 and all((r["model_a"], r["model_b"]) == ("only", "only") for r in out)


def test_poisson_copies_are_poisson_and_unique():
    ids = np.arange(20_000) * 7 + 2**40
    one, key = draws.poisson_copies(ids, 3, 17)
    counts = np.bincount(one, minlength=len(ids))
    assert abs(counts.mean() - 1) < 0.03 and abs(counts.var() - 1) < 0.06
    assert abs((counts == 0).mean() - np.exp(-1)) < 0.02
    assert len(np.unique(key)) == len(key) and key.min() >= 0
    # Order and count are independent of one another, of the id and of the replicate.
    assert abs(np.corrcoef(np.argsort(np.argsort(key)), one)[0, 1]) < 0.03
    other = np.bincount(draws.poisson_copies(ids, 4, 17)[0], minlength=len(ids))
    assert abs(np.corrcoef(counts, other)[0, 1]) < 0.03
    part, again = draws.poisson_copies(ids[5000:], 3, 17)
    assert sorted(again) == sorted(key[one >= 5000]) and (part + 5000 == one[one >= 5000]).all()


def test_resampled_elo_in_blocks_equals_the_loop_and_the_chunks(spark):
    rows = random_battles(150, systems=2) + [("s0", 9001, "x", "x", "vote_left")]
    df, rounds = frame(spark, rows), 40
    call = dict(rounds=rounds, seed=5, largest=ratings.largest_group(df, ["system"]))
    blocks = ratings.resampled_elo(df, ["system"], "seq", **call)
    chunks = ratings.resampled_elo(df, ["system"], "seq", rows_per_block=1, rows_per_chunk=60, **call)
    ours = {(r["system"], r["replicate"], r["model"]): r["rating"] for r in blocks.collect()}
    other = {(r["system"], r["replicate"], r["model"]): r["rating"] for r in chunks.collect()}
    plain = {}
    for system in ("s0", "s1"):
        part = sorted((r for r in rows if r[0] == system), key=lambda r: r[1])
        for replicate in range(rounds):
            row, key = draws.poisson_copies(np.array([r[1] for r in part]), replicate, 5)
            copies = [(system, k, *part[i][2:]) for i, k in zip(row.tolist(), key.tolist())]
            plain.update({(system, replicate, m): v for m, v in plain_elo(copies).items()})
    assert ours.keys() == plain.keys() == other.keys()
    assert all(ours[k] == pytest.approx(v, abs=1e-9) and other[k] == pytest.approx(v, abs=1e-9) for k, v in plain.items())


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000, 1023])
def test_shuffled_positions_are_a_permutation(spark, size):
    place = draws.shuffled_position(F.col("id"), F.lit(size).cast("bigint"), F.col("key"))
    rows = spark.range(size + 2).crossJoin(spark.createDataFrame([(5,), (2**59 + 11,)], "key bigint"))
    out = rows.select("key", "id", place.alias("at")).collect()
    for key in (5, 2**59 + 11):
        assert sorted(r["at"] for r in out if r["key"] == key and r["id"] < size) == list(range(size))
    assert all(r["at"] is None for r in out if r["id"] >= size)


def test_places_of_a_slot_are_even_over_keys(spark):
    place = draws.shuffled_position(F.lit(1).cast("bigint"), F.lit(10).cast("bigint"), draws.draw(3, "id"))
    counts = [r["count"] for r in spark.range(20_000).groupBy(place.alias("at")).count().collect()]
    assert len(counts) == 10 and min(counts) > 1800 and max(counts) < 2200


def test_range_buckets_by_halving(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id") % 997).alias("x"))
    for buckets in (2, 3, 64, 700):
        rows = draws.range_bucket(df, "x", buckets).groupBy("x").agg(F.min("bucket").alias("b"), F.max("bucket").alias("c")).orderBy("x").collect()
        found = [r["b"] for r in rows]
        assert found == [r["c"] for r in rows] == sorted(found) and found[0] == 0 and len(set(found)) > buckets / 2


def test_pairs_of_many_models_follow_the_weights(spark):
    """700 models in three blocks of rivals: every model keeps its share, nobody meets itself."""
    from verdictframe.operators import worklist

    models = spark.range(700).selectExpr(
        "concat('m', id) model", "IF(id < 10, 70.0D, 1.0D) weight", "false outage", "false boost", "id >= 695 anonymous",
        "CAST(NULL AS ARRAY<STRING>) strict", "CAST(NULL AS ARRAY<STRING>) targets",
    )
    rows = worklist.battle_pairs(spark.range(6000).withColumnRenamed("id", "prompt"), models, "prompt").collect()
    assert len(rows) == 6000 == len({r["prompt"] for r in rows}) and all(r["model_a"] != r["model_b"] for r in rows)
    heavy = sum((m in {f"m{i}" for i in range(10)}) for r in rows for m in (r["model_a"], r["model_b"]))
    first = 700 / 1390
    expected = 6000 * (first + first * 630 / 1320 + (1 - first) * 700 / 1389)
    assert abs(heavy - expected) < 300
    hidden = {f"m{i}" for i in range(695, 700)}
    assert not any({r["model_a"], r["model_b"]} <= hidden for r in rows)


def test_large_resamples_write_no_copies(spark):
    """Beyond a block the draws come in slices of time; the battles themselves travel once per block."""
    df = frame(spark, [("s", i, f"m{i % 5}", f"m{(i * 7 + 1) % 5}", ["vote_left", "vote_right", "vote_tie"][i % 3]) for i in range(400)])
    call = {"rounds": 40, "seed": 5, "largest": 400}
    sliced = ratings.resampled_elo(df, ["system"], "seq", rows_per_block=1, rows_per_chunk=90, **call)
    assert "MapInPandas" not in sliced._jdf.queryExecution().executedPlan().toString()
    one = {tuple(r)[:3]: r["rating"] for r in ratings.resampled_elo(df, ["system"], "seq", **call).collect()}
    cut = {tuple(r)[:3]: r["rating"] for r in sliced.collect()}
    assert one.keys() == cut.keys() and all(abs(one[k] - cut[k]) < 1e-9 for k in one)


def test_battles_are_kept_in_numbers():
    """Pieces in any order fold like the whole; what is kept are four numbers a battle."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    rows = pd.DataFrame({"seq": rng.permutation(500), "model_a": rng.choice(list("abc"), 500), "model_b": rng.choice(list("bcd"), 500), "score": rng.choice([0, 0.5, 1], 500)})
    whole, cut = ratings.Battles("seq"), ratings.Battles("seq")
    whole.add(rows.sort_values("seq"))
    for first in range(0, 500, 60):
        cut.add(rows.iloc[first : first + 60])
    assert sum(c.nbytes for part in cut.parts for c in part) == 24 * 500
    one, two = {}, {}
    assert whole.fold(one, 4.0, 400.0, 10.0, 1000.0) == cut.fold(two, 4.0, 400.0, 10.0, 1000.0) == set("abcd")
    assert one == two


def test_numbered_draws_are_md5():
    import hashlib

    from verdictframe.functions.draws import numbered_draws

    for prefix in ("17:Overall:m:3", "x" * 53, "é" * 40, "y" * 130):
        want = [int(hashlib.md5(f"{prefix}:{i}".encode()).hexdigest()[:15], 16) for i in range(95, 1105)]
        assert numbered_draws(prefix, 95, 1105).tolist() == want


def test_battles_of_a_resample_are_kept_in_six_bytes(spark):
    """Stored pieces hold a word and a cell per battle; only these travel to the blocks."""
    df = frame(spark, [("s", i, f"m{i % 5}", f"m{(i * 7 + 1) % 5}", ["vote_left", "vote_right", "vote_tie"][i % 3]) for i in range(3000)])
    packed = ratings.packed_battles(df, ["system"], "seq", "vote").collect()
    assert sum(len(r["words"]) + len(r["cells"]) for r in packed) == 6 * 3000
    rows = ratings.Packed()
    for r in reversed(packed):
        rows.add(r.asDict())
    pieces = rows.ordered()
    assert (np.concatenate([w for w, _ in pieces]) == draws.words(np.arange(3000))).all()
    cells = [c for c, _ in sorted(rows.cells.items(), key=lambda x: x[1])]
    assert [cells[c][0] for c in np.concatenate([c for _, c in pieces])] == [f"m{i % 5}" for i in range(3000)]
    out = ratings.resampled_elo(df, [], "seq", rounds=40, seed=5, largest=3000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "words" in plan and "model_a" not in plan


def test_slices_of_draws_follow_the_sort_keys():
    """Slices of one resample give its copies in the order of their keys, also where keys share their first bits."""
    rng = np.random.default_rng(1)
    word = draws.words(np.repeat(np.arange(2000), 2))  # battles of one number share their keys
    cell = rng.integers(0, 300, len(word)).astype(np.uint16)
    row, key = draws.hashed_copies(word, 7, 17)
    want = cell[row][np.argsort(key, kind="stable")]
    pieces = [(word[i : i + 900], cell[i : i + 900]) for i in range(0, len(word), 900)]
    met = np.zeros((1, 301), dtype=bool)
    found = [ratings._block_picks(pieces, range(7, 8), 17, (1 << 31) * i // 3, (1 << 31) * (i + 1) // 3, met)[0] for i in range(3)]
    assert (np.concatenate(found) == want).all() and set(np.flatnonzero(met[0])) == set(want.tolist())
