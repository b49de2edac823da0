"""Streams: batches add up to the batch result, retried batches count once."""

import time

from pyspark.sql import functions as F

from tests.test_ratings import frame, plain_elo, random_battles
from verdictframe.operators import battles, ratings
from verdictframe.session import scratch_path
from verdictframe.streaming import elo, logs, votes


def space_votes(spark, rows):
    names = F.create_map(*[F.lit(x) for x in ("vote_left", "left", "vote_right", "right", "vote_tie", "tie")])
    return frame(spark, rows).withColumn("vote", names[F.col("vote")])


def test_retried_batch_counts_once(spark):
    rows = random_battles(60)
    path = scratch_path(spark, "retry")
    step = votes.pair_count_step(path)
    parts = [space_votes(spark, rows[:30]), space_votes(spark, rows[30:])]
    step(parts[0], 0)
    step(parts[1], 1)
    step(parts[1], 1)
    got = {tuple(r) for r in votes.stored_pair_counts(spark, path).collect()}
    want = battles.pair_outcomes(battles.winners(space_votes(spark, rows)), [], "winner")
    assert got == {tuple(r) for r in want.select("model_a", "model_b", "a_win", "b_win", "tie").collect()}


def test_retried_elo_batch_starts_from_its_predecessor(spark):
    rows = sorted(random_battles(90), key=lambda r: r[1])
    path = scratch_path(spark, "elo")
    step = elo.elo_step(path, ["system"], rows_per_chunk=20)
    for number, low in enumerate((0, 30, 60)):
        step(frame(spark, rows[low:low + 30]), number)
        step(frame(spark, rows[low:low + 30]), number)
    got = {r["model"]: r["rating"] for r in votes.newest(spark, path).collect()}
    for model, value in plain_elo(rows).items():
        assert abs(got[model] - value) < 1e-9


def test_last_leaderboard_equals_the_batch_fit(spark):
    rows = random_battles(200)
    out = scratch_path(spark, "board")
    step = votes.leaderboard_step(f"{out}/counts", f"{out}/board")
    step(space_votes(spark, rows[:120]), 0)
    step(space_votes(spark, rows[120:]), 1)
    got = {r["model"]: r["rating"] for r in votes.newest(spark, f"{out}/board").collect()}
    whole = ratings.fit_pairs(battles.pair_outcomes(frame(spark, rows), []), [])
    for r in whole.collect():
        assert abs(got[r["model"]] - r["rating"]) < 1e-6


def test_worklist_takes_each_key_once(spark):
    """Over several arrivals, with the stream started again after each."""
    path = scratch_path(spark, "work")
    for keys in (["a", "a", "b"], ["b", "c"], ["c", "a", "d"]):
        spark.createDataFrame([(k,) for k in keys], "k string").write.mode("append").parquet(f"{path}/in")
        live = votes.vote_stream(spark, f"{path}/in", "k string", kind="parquet")
        step = votes.keep_step(f"{path}/taken")
        votes.per_batch(logs.taken_once(live, "k"), step, f"{path}/checkpoint").awaitTermination()
    taken = spark.read.schema("k string, batch int").parquet(f"{path}/taken")
    assert sorted(r["k"] for r in taken.collect()) == ["a", "b", "c", "d"]


def worklist_run(spark, path, rows, keep_ms):
    """One arrival of (key, state) rows; the query that handled it."""
    spark.createDataFrame(rows, "k string, state string").write.mode("append").parquet(f"{path}/in")
    live = votes.vote_stream(spark, f"{path}/in", "k string, state string", kind="parquet")
    changes = logs.worklist_status(live, "k", retries=1, keep_ms=keep_ms)
    run = logs.run_worklist(changes, votes.keep_step(f"{path}/changes"), f"{path}/checkpoint")
    assert run.awaitTermination(60)
    return run


def stored_changes(spark, path):
    return spark.read.schema("k string, status string, attempt int, take boolean, batch int").parquet(f"{path}/changes")


def test_failed_work_returns_until_it_is_given_up(spark):
    path = scratch_path(spark, "retries")
    steps = [
        [("a", "arrived"), ("a", "arrived"), ("b", "arrived"), (None, "arrived")],
        [("a", "failed"), ("b", "completed"), ("c", "arrived")],
        [("a", "failed"), ("b", "failed"), ("c", None), (None, "failed")],
        [("a", "arrived")],
    ]
    for rows in steps:
        worklist_run(spark, path, rows, 3_600_000)
    taken = sorted((r["k"] or "-", r["attempt"]) for r in stored_changes(spark, path).filter("take").collect())
    assert taken == [("-", 1), ("-", 2), ("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    last = {r["k"]: (r["status"], r["attempt"]) for r in logs.latest_status(stored_changes(spark, path), "k").collect()}
    assert last == {"a": ("given_up", 2), "b": ("completed", 2), "c": ("open", 1), None: ("open", 2)}


def test_worklist_state_expires(spark):
    """Keys without events leave the state; a hot key takes one row of it."""
    path = scratch_path(spark, "expiry")
    worklist_run(spark, path, [(f"k{i}", "arrived") for i in range(50)] + [("hot", "arrived")] * 500, 1)
    for key in ("x", "y"):
        time.sleep(0.2)
        run = worklist_run(spark, path, [(key, "arrived")], 1)
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert min(rows) <= 1
    assert stored_changes(spark, path).filter("k = 'hot'").count() == 1


def test_worklist_keeps_groups_of_keys(spark):
    """Many keys make no more states, and no more calls of the fold, than there are groups; whole numbers stay exact."""
    path = scratch_path(spark, "groups")
    top = 2**53
    for number in range(2):
        rows = spark.range(3000).selectExpr(f"CASE WHEN id > 0 THEN id + {top} END AS k", "CASE WHEN id % 3 = 0 THEN 'failed' WHEN id % 3 = 1 THEN 'completed' END AS state")
        rows.write.mode("append").parquet(f"{path}/in")
        live = votes.vote_stream(spark, f"{path}/in", "k bigint, state string", kind="parquet")
        run = logs.run_worklist(logs.worklist_status(live, "k", retries=1), votes.keep_step(f"{path}/changes"), f"{path}/checkpoint")
        assert run.awaitTermination(60)
        states = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
        assert max(states) <= logs.KEY_GROUPS
    stored = spark.read.schema("k bigint, status string, attempt int, take boolean, batch int").parquet(f"{path}/changes")
    assert stored.count() == 6000
    last = {r["k"]: (r["status"], r["attempt"]) for r in logs.latest_status(stored, "k").collect()}
    kinds = [("given_up", 2), ("completed", 1), ("open", 1)]
    assert last == {(k + top if k else None): kinds[k % 3] for k in range(3000)}
    assert stored.filter("take").count() == 2000


def test_counts_read_the_last_batch_only(spark):
    path = scratch_path(spark, "running")
    step = votes.pair_count_step(path)
    rows = random_battles(60)
    for number in range(3):
        step(space_votes(spark, rows[20 * number:20 * number + 20]), number)
    assert votes.batch_numbers(spark, path) == [0, 1, 2]
    total = votes.newest(spark, path).selectExpr("sum(a_win + b_win + tie) n").first()["n"]
    assert total == len(rows) and votes.newest(spark, path, 0) is None


def test_json_vote_stream_has_the_declared_schema(spark):
    path = scratch_path(spark, "json")
    line = '{"timestamp": "2024-01-01T00:00:00", "model_a": "x", "model_b": "y", "vote": "left", "conversation_a": [{"role": "user", "content": "hi"}]}'
    spark.createDataFrame([(line,)], "value string").write.text(f"{path}/in")
    query = votes.ingest(votes.vote_stream(spark, f"{path}/in"), f"{path}/out", f"{path}/checkpoint")
    query.awaitTermination()
    row = spark.read.parquet(f"{path}/out").first()
    assert row["vote"] == "left" and row["conversation_a"][0]["content"] == "hi"
