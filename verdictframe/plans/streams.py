"""Streaming queries: the given events arrive in four steps, in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.plans.ratings import elo_sql, strength_sql
from verdictframe.plans.registry import query
from verdictframe.session import scratch_path as fresh
from verdictframe.sources.views import view
from verdictframe.streaming import elo, logs, votes

PARTS = 4


def feed(spark, rows, order: str, folder: str, start) -> None:
    """Let ``rows`` arrive in ``PARTS`` steps of rising ``order``.

    After each arrival the stream is started on all new input and resumes from
    its checkpoint, as it would after a restart of the application.
    """
    cuts = rows.agg(F.percentile_approx(order, [i / PARTS for i in range(1, PARTS)], 1000)).first()[0]
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = rows
        if low is not None:
            part = part.filter(F.col(order) > F.lit(low))
        if high is not None:
            part = part.filter(F.col(order) <= F.lit(high))
        part.write.mode("append").parquet(f"{folder}/in")
        live = votes.vote_stream(spark, f"{folder}/in", rows.schema, kind="parquet")
        start(live).awaitTermination()


@query("stream_ingested_votes", "SELECT seq, model_a, model_b, vote FROM space_votes")
def stream_ingested_votes(spark, sf):
    rows = view(spark, sf, "space_votes").select("seq", "model_a", "model_b", "vote")
    out = fresh(spark, "ingested")
    feed(spark, rows, "seq", out, lambda live: votes.ingest(live, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{out}/table")


@query("stream_running_stats", """WITH s AS (SELECT model_a AS model, CASE vote WHEN 'left' THEN 'w' WHEN 'right' THEN 'l' ELSE 't' END AS r FROM space_votes WHERE vote <> 'flag'
 UNION ALL SELECT model_b, CASE vote WHEN 'right' THEN 'w' WHEN 'left' THEN 'l' ELSE 't' END FROM space_votes WHERE vote <> 'flag')
SELECT model, count(*) AS total, count(*) FILTER (r = 'w') AS wins, count(*) FILTER (r = 't') AS ties, count(*) FILTER (r = 'l') AS losses FROM s GROUP BY model""")
def stream_running_stats(spark, sf):
    rows = view(spark, sf, "space_votes").select("seq", "model_a", "model_b", "vote")
    out = fresh(spark, "running")

    def start(live):
        stats = votes.running_stats(live)
        return votes.per_batch(stats, votes.keep_step(f"{out}/stats"), f"{out}/checkpoint", mode="complete")

    feed(spark, rows, "seq", out, start)
    return votes.newest(spark, f"{out}/stats")


@query("stream_pair_counts", """SELECT model_a, model_b, count(*) FILTER (vote = 'left') AS a_win, count(*) FILTER (vote = 'right') AS b_win,
 count(*) FILTER (vote IN ('tie', 'both_bad')) AS tie FROM space_votes WHERE vote <> 'flag' GROUP BY ALL""")
def stream_pair_counts(spark, sf):
    rows = view(spark, sf, "space_votes").select("seq", "model_a", "model_b", "vote")
    out = fresh(spark, "pairs")
    step = votes.pair_count_step(f"{out}/counts")
    feed(spark, rows, "seq", out, lambda live: votes.per_batch(live, step, f"{out}/checkpoint"))
    return votes.stored_pair_counts(spark, f"{out}/counts")


@query("stream_leaderboard", f"""WITH v AS (SELECT 0 AS g, model_a, model_b, vote FROM space_votes WHERE vote <> 'flag'), {strength_sql('v', 'g', ('left', 'right'))}
SELECT model, round(rating, 4) AS rating, battles FROM strengths""")
def stream_leaderboard(spark, sf):
    """Refit after every batch; the last board is the fit of all votes."""
    rows = view(spark, sf, "space_votes").select("seq", "model_a", "model_b", "vote")
    out = fresh(spark, "board")
    step = votes.leaderboard_step(f"{out}/counts", f"{out}/board")
    feed(spark, rows, "seq", out, lambda live: votes.per_batch(live, step, f"{out}/checkpoint"))
    return votes.newest(spark, f"{out}/board").select("model", F.round("rating", 4).alias("rating"), "battles")


@query("stream_elo", f"""WITH {elo_sql('system_battles', 'system', 'seq')}
SELECT key AS system, model, round(rating, 4) AS rating FROM elo_final""")
def stream_elo(spark, sf):
    rows = view(spark, sf, "system_battles")
    out = fresh(spark, "elo")
    step = elo.elo_step(f"{out}/ratings", ["system"])
    feed(spark, rows, "seq", out, lambda live: votes.per_batch(live, step, f"{out}/checkpoint"))
    return votes.newest(spark, f"{out}/ratings").select("system", "model", F.round("rating", 4).alias("rating"))


@query("stream_keyed_elo", f"""WITH {elo_sql('system_battles', 'system', 'seq')}
SELECT key AS system, model, round(rating, 4) AS rating FROM elo_final""")
def stream_keyed_elo(spark, sf):
    """The fold as keyed state; changes are stored per trigger."""
    rows = view(spark, sf, "system_battles")
    out = fresh(spark, "keyed-elo")

    def start(live):
        changes = elo.keyed_elo(live)
        return votes.per_batch(changes, votes.keep_step(f"{out}/changes"), f"{out}/checkpoint", mode="update")

    feed(spark, rows, "seq", out, start)
    stored = spark.read.schema("system string, model string, rating double, batch int").parquet(f"{out}/changes")
    return elo.latest_ratings(stored).select("system", "model", F.round("rating", 4).alias("rating"))


@query("stream_worklist", "SELECT DISTINCT chat_session_id FROM judge_rows")
def stream_worklist(spark, sf):
    """Every session is taken up once, however often it arrives."""
    rows = view(spark, sf, "judge_rows").select("seq", "chat_session_id")
    out = fresh(spark, "worklist")
    step = votes.keep_step(f"{out}/taken")
    feed(spark, rows, "seq", out, lambda live: votes.per_batch(logs.taken_once(live, "chat_session_id"), step, f"{out}/checkpoint"))
    return spark.read.schema("chat_session_id string, batch int").parquet(f"{out}/taken").select("chat_session_id")


WORK_EVENTS = """w AS (SELECT chat_session_id, seq, CASE WHEN judgment IS NULL THEN 'failed' WHEN judgment = 'error' AND judge = 'jA' THEN 'failed'
  WHEN judgment = 'error' OR seq % 7 = 0 THEN 'arrived' ELSE 'completed' END AS state FROM judge_rows)"""


@query("stream_worklist_retries", f"""WITH {WORK_EVENTS}, c AS (SELECT chat_session_id, count(*) FILTER (state = 'failed') AS failures, bool_or(state = 'completed') AS done FROM w GROUP BY 1)
SELECT chat_session_id, CASE WHEN done THEN 'completed' WHEN failures > 2 THEN 'given_up' ELSE 'open' END AS status, (least(failures, 2) + 1)::INT AS attempt FROM c""")
def stream_worklist_retries(spark, sf):
    """Failed sessions return to the worklist until their retries are used up."""
    missing, wrong = F.col("judgment").isNull(), F.col("judgment") == "error"
    state = F.when(missing | (wrong & (F.col("judge") == "jA")), "failed").when(wrong | (F.col("seq") % 7 == 0), "arrived")
    rows = view(spark, sf, "judge_rows").select("seq", "chat_session_id", F.coalesce(state, F.lit("completed")).alias("state"))
    out = fresh(spark, "retries")

    def start(live):
        changes = logs.worklist_status(live, "chat_session_id", retries=2)
        return logs.run_worklist(changes, votes.keep_step(f"{out}/changes"), f"{out}/checkpoint")

    feed(spark, rows, "seq", out, start)
    stored = spark.read.schema("chat_session_id string, status string, attempt int, take boolean, batch int").parquet(f"{out}/changes")
    return logs.latest_status(stored, "chat_session_id")


@query("stream_logs", """SELECT event_id, strftime(ts, '%Y_%m_%d') AS date, CASE WHEN user_id % 2 = 0 THEN 'battle_anony' ELSE 'direct' END AS chat_mode,
 strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS first_time, 'sandbox-logs-' || user_id || '-1-' || event_id || '.json' AS name FROM events""")
def stream_logs(spark, sf):
    rows = view(spark, sf, "events")
    out = fresh(spark, "logs")

    def start(live):
        turns = F.array(F.array(F.struct(F.col("ts").alias("time"), F.col("event_type").alias("action"))))
        records = live.select(
            "event_id", "ts", F.when(F.col("user_id") % 2 == 0, "battle_anony").otherwise("direct").alias("chat_mode"),
            logs.serialised_interactions(turns).alias("interactions"),
            logs.log_name(F.col("user_id"), F.lit(1), F.col("event_id")).alias("name"),
        )
        return logs.write_log_stream(records, f"{out}/table", f"{out}/checkpoint", "ts")

    feed(spark, rows, "event_id", out, start)
    read = spark.read.schema(
        "event_id bigint, interactions array<array<struct<time:string,action:string>>>, name string, date string, chat_mode string"
    ).json(f"{out}/table")
    return read.select("event_id", "date", "chat_mode", F.col("interactions")[0][0]["time"].alias("first_time"), "name")


@query("latency_stats", """WITH r AS (SELECT event_type AS model, epoch(ts) AS s, epoch(ts) + value AS e FROM events),
 t AS (SELECT model, round(round(e, 4) - round(s, 4), 4) AS seconds FROM r)
SELECT model, count(*) AS n, round(avg(seconds), 4) AS mean, round(quantile_cont(seconds, 0.5), 4) AS p50, round(quantile_cont(seconds, 0.95), 4) AS p95 FROM t GROUP BY model""")
def latency_stats(spark, sf):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = view(spark, sf, "events").select(
        F.col("event_type").alias("model"), start.alias("start_ts"), (start + F.col("value")).alias("end_ts")
    )
    out = logs.latency_stats(logs.response_records(rows), ["model"])
    return out.select("model", "n", *[F.round(c, 4).alias(c) for c in ("mean", "p50", "p95")])
