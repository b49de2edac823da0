"""Vote normalisation, battle statistics, latest-wins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions.predicates import all_present, merged_label, vote_of
from verdictframe.operators import battles as ops
from verdictframe.plans.registry import query
from verdictframe.session import scratch_path
from verdictframe.sources import sinks
from verdictframe.sources.views import view

VOTE_CASE = """CASE {c} WHEN 'vote_model_A' THEN 'vote_left' WHEN 'vote_model_B' THEN 'vote_right'
 WHEN 'vote_left' THEN 'vote_left' WHEN 'vote_right' THEN 'vote_right'
 WHEN 'vote_tie' THEN 'vote_tie' WHEN 'vote_both_bad' THEN 'vote_both_bad' END"""


@query("votes_normalised", f"""
SELECT seq, {VOTE_CASE.format(c='human_vote')} AS vote FROM raw_votes
WHERE {VOTE_CASE.format(c='human_vote')} IS NOT NULL""")
def votes_normalised(spark, sf):
    raw = view(spark, sf, "raw_votes")
    return raw.select("seq", vote_of("human_vote").alias("vote")).filter("vote IS NOT NULL")


@query("vote_conversion_tally", f"""
SELECT human_vote AS raw_vote, {VOTE_CASE.format(c='human_vote')} AS vote, count(*) AS n
FROM raw_votes WHERE {VOTE_CASE.format(c='human_vote')} IS NOT NULL GROUP BY 1, 2""")
def vote_conversion_tally(spark, sf):
    return ops.vote_conversion_tally(view(spark, sf, "raw_votes"))


@query("winners_normalised", """
SELECT seq, model_a, model_b, CASE vote WHEN 'left' THEN 'model_a' WHEN 'right' THEN 'model_b'
 WHEN 'tie' THEN 'tie' ELSE 'tie (bothbad)' END AS winner
FROM space_votes WHERE vote IN ('left','right','tie','both_bad')""")
def winners_normalised(spark, sf):
    return ops.winners(view(spark, sf, "space_votes")).select("seq", "model_a", "model_b", "winner")


@query("required_fields", """
SELECT seq, chat_session_id, model_a, model_b, human_vote FROM raw_votes
WHERE chat_session_id <> '' AND model_a <> '' AND model_b <> '' AND human_vote <> ''""")
def required_fields(spark, sf):
    cols = ["chat_session_id", "model_a", "model_b", "human_vote"]
    return view(spark, sf, "raw_votes").filter(all_present(*cols)).select("seq", *cols)


@query("human_battles", f"""
SELECT seq, model_a, model_b, {VOTE_CASE.format(c='human_vote')} AS vote FROM raw_votes
WHERE chat_session_id <> '' AND model_a <> '' AND model_b <> '' AND human_vote <> ''
AND {VOTE_CASE.format(c='human_vote')} IS NOT NULL""")
def human_battles(spark, sf):
    return ops.human_battles(view(spark, sf, "raw_votes")).select("seq", "model_a", "model_b", "vote")


HUMAN_LATEST = f"""
SELECT chat_session_id, vote, category_name, original_vote FROM (
 SELECT chat_session_id, {VOTE_CASE.format(c='raw')} AS vote, category_name, raw AS original_vote,
  row_number() OVER (PARTITION BY chat_session_id ORDER BY seq DESC) AS rn FROM (
  SELECT seq, chat_session_id, coalesce(category_name,'unknown') AS category_name,
   CASE WHEN human_vote <> '' THEN human_vote ELSE vote_type END AS raw FROM raw_votes WHERE chat_session_id <> '')
 WHERE {VOTE_CASE.format(c='raw')} IS NOT NULL) WHERE rn = 1"""


@query("human_votes_latest", HUMAN_LATEST)
def human_votes_latest(spark, sf):
    return ops.human_votes_latest(view(spark, sf, "raw_votes"))


@query("merged_labels", """
SELECT CASE WHEN vote IN ('vote_tie','vote_both_bad') THEN 'vote_uncertain' ELSE vote END AS label, count(*) AS n
FROM battles GROUP BY 1""")
def merged_labels(spark, sf):
    labels = view(spark, sf, "battles").select(merged_label("vote").alias("label"))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("first_battles", "SELECT seq, model_a, model_b, vote FROM battles ORDER BY seq LIMIT 25")
def first_battles(spark, sf):
    return view(spark, sf, "battles").select("seq", "model_a", "model_b", "vote").orderBy("seq").limit(25)


SIDES = """sides AS (
 SELECT model_a AS model, CASE vote WHEN 'vote_left' THEN 'win' WHEN 'vote_right' THEN 'loss' ELSE 'tie' END AS result FROM battles
 UNION ALL SELECT model_b, CASE vote WHEN 'vote_right' THEN 'win' WHEN 'vote_left' THEN 'loss' ELSE 'tie' END FROM battles)"""


@query("battle_stats", f"""WITH {SIDES}
SELECT model, count(*) AS total, count(*) FILTER (result='win') AS wins, count(*) FILTER (result='tie') AS ties,
 count(*) FILTER (result='loss') AS losses, round(count(*) FILTER (result='win') / count(*), 6) AS win_rate,
 round(count(*) FILTER (result='tie') / count(*), 6) AS tie_rate,
 round(count(*) FILTER (result='loss') / count(*), 6) AS loss_rate FROM sides GROUP BY model""")
def battle_stats(spark, sf):
    stats = ops.battle_stats(view(spark, sf, "battles"))
    return stats.select(
        "model", "total", "wins", "ties", "losses",
        *[F.round(c, 6).alias(c) for c in ("win_rate", "tie_rate", "loss_rate")],
    )


@query("battle_stats_by_system", """
WITH s AS (SELECT system, model_a AS model, CASE vote WHEN 'vote_left' THEN 1 ELSE 0 END AS w FROM system_battles
 UNION ALL SELECT system, model_b, CASE vote WHEN 'vote_right' THEN 1 ELSE 0 END FROM system_battles)
SELECT system, model, count(*) AS total, sum(w)::BIGINT AS wins, round(sum(w)/count(*), 6) AS win_rate
FROM s GROUP BY system, model""")
def battle_stats_by_system(spark, sf):
    stats = ops.battle_stats(view(spark, sf, "system_battles"), ["system"])
    return stats.select("system", "model", "total", "wins", F.round("win_rate", 6).alias("win_rate"))


@query("vote_counts", """
SELECT model, count(*) AS votes FROM (SELECT model_a AS model FROM battles UNION ALL SELECT model_b FROM battles) GROUP BY model""")
def vote_counts(spark, sf):
    return ops.vote_counts(view(spark, sf, "battles"))


@query("pair_outcomes", """
SELECT model_a, model_b, count(*) FILTER (vote='vote_left') AS a_win, count(*) FILTER (vote='vote_right') AS b_win,
 count(*) FILTER (vote IN ('vote_tie','vote_both_bad')) AS tie FROM battles GROUP BY model_a, model_b""")
def pair_outcomes(spark, sf):
    return ops.pair_outcomes(view(spark, sf, "battles"))


@query("system_stats", """
SELECT system, count(*)//2 AS total_battles, count(DISTINCT model) AS unique_models FROM (
 SELECT system, model_a AS model FROM system_battles UNION ALL SELECT system, model_b FROM system_battles) GROUP BY system""")
def system_stats(spark, sf):
    return ops.system_stats(view(spark, sf, "system_battles"))


@query("system_vote_distribution", "SELECT system, vote, count(*) AS n FROM system_battles GROUP BY system, vote")
def system_vote_distribution(spark, sf):
    return ops.vote_distribution(view(spark, sf, "system_battles"))


@query("latest_per_session", """
SELECT chat_session_id, seq, model_a, human_vote FROM (
 SELECT *, row_number() OVER (PARTITION BY chat_session_id ORDER BY seq DESC) AS rn FROM raw_votes) WHERE rn = 1""")
def latest_per_session(spark, sf):
    rows = view(spark, sf, "raw_votes").select("chat_session_id", "seq", "model_a", "human_vote")
    return ops.latest(rows, ["chat_session_id"], "seq")


@query("rank_by_win_rate", """
WITH s AS (SELECT system, model_a AS model, CASE vote WHEN 'vote_left' THEN 1 ELSE 0 END AS w FROM system_battles
 UNION ALL SELECT system, model_b, CASE vote WHEN 'vote_right' THEN 1 ELSE 0 END FROM system_battles),
r AS (SELECT system, model, round(sum(w)/count(*), 4) AS win_rate FROM s GROUP BY system, model)
SELECT system, model, win_rate, row_number() OVER (PARTITION BY system ORDER BY win_rate DESC, model) AS rank FROM r""")
def rank_by_win_rate(spark, sf):
    stats = ops.battle_stats(view(spark, sf, "system_battles"), ["system"])
    rates = stats.select("system", "model", F.round("win_rate", 4).alias("win_rate"))
    return ops.ranked(rates, ["system"], [F.desc("win_rate"), F.col("model")]).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


@query("union_of_sources", """
SELECT source, count(*) AS n, count(category_name) AS with_category FROM (
 SELECT 'raw' AS source, chat_session_id, category_name FROM raw_votes UNION ALL
 SELECT 'judge', chat_session_id, NULL FROM judge_rows) GROUP BY source""")
def union_of_sources(spark, sf):
    raw = view(spark, sf, "raw_votes").select(F.lit("raw").alias("source"), "chat_session_id", "category_name")
    judge = view(spark, sf, "judge_rows").select(F.lit("judge").alias("source"), "chat_session_id")
    rows = raw.unionByName(judge, allowMissingColumns=True)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("category_name").alias("with_category"))


@query("union_of_models", "SELECT model_a AS model FROM battles UNION SELECT model_b FROM battles")
def union_of_models(spark, sf):
    b = view(spark, sf, "battles")
    return b.select(F.explode(F.array("model_a", "model_b")).alias("model")).distinct()


@query("common_models", """
(SELECT model_a AS model FROM system_battles WHERE system = 'Human Votes' UNION SELECT model_b FROM system_battles WHERE system = 'Human Votes')
INTERSECT (SELECT model_a FROM system_battles WHERE system = 'jA (with_execution)' UNION SELECT model_b FROM system_battles WHERE system = 'jA (with_execution)')""")
def common_models(spark, sf):
    """Models that stand on either side of a battle in both systems."""
    rows = view(spark, sf, "system_battles").select("system", F.explode(F.array("model_a", "model_b")).alias("model"))

    def of(system: str):
        return rows.filter(F.col("system") == system).select("model")

    return of("Human Votes").intersect(of("jA (with_execution)"))


@query("sessions_without_judgment", """
SELECT DISTINCT chat_session_id FROM raw_votes WHERE chat_session_id NOT IN
 (SELECT chat_session_id FROM judge_rows WHERE judge='jA' AND mode='with_execution' AND judgment <> 'error')""")
def sessions_without_judgment(spark, sf):
    done = view(spark, sf, "judge_rows").filter(
        "judge = 'jA' AND mode = 'with_execution' AND judgment <> 'error'"
    )
    return view(spark, sf, "raw_votes").join(done, "chat_session_id", "left_anti").select("chat_session_id").distinct()


@query("appended_votes", """
SELECT vote, count(*) AS n FROM (SELECT vote FROM space_votes UNION ALL
 SELECT vote FROM space_votes WHERE vote = 'both_bad') GROUP BY vote""")
def appended_votes(spark, sf):
    """Votes written, new ones appended as files of their own, and all read back."""
    path = scratch_path(spark, "votes")
    votes = view(spark, sf, "space_votes").select("seq", "vote")
    sinks.append_votes(votes, path)
    sinks.append_votes(votes.filter("vote = 'both_bad'"), path)
    return spark.read.schema(votes.schema).parquet(path).groupBy("vote").agg(F.count(F.lit(1)).alias("n"))


SESSION_PAIRS = """
SELECT concat('s', cast(conv_id - conv_id % 2 AS string)) AS chat_session_id, CASE conv_id % 2 WHEN 0 THEN 'A' ELSE 'B' END AS side,
 turn, role, text FROM conversations"""


def session_messages(spark, sf):
    c = view(spark, sf, "conversations")
    return c.select(
        F.concat(F.lit("s"), (F.col("conv_id") - F.col("conv_id") % 2).cast("string")).alias("chat_session_id"),
        F.when(F.col("conv_id") % 2 == 0, "A").otherwise("B").alias("side"),
        "turn", "role", "text",
    )


@query("paired_sessions", f"""WITH m AS ({SESSION_PAIRS})
SELECT chat_session_id, count(*) FILTER (side='A') AS turns_a, count(*) FILTER (side='B') AS turns_b,
 arg_min(text, turn) FILTER (side='A') AS first_a, arg_max(text, turn) FILTER (side='B') AS last_b
FROM m GROUP BY chat_session_id HAVING count(*) FILTER (side='A') > 0 AND count(*) FILTER (side='B') > 0""")
def paired_sessions(spark, sf):
    pairs = ops.pair_sessions(session_messages(spark, sf))
    return pairs.select(
        "chat_session_id",
        F.size("history_a").cast("bigint").alias("turns_a"),
        F.size("history_b").cast("bigint").alias("turns_b"),
        F.element_at("history_a", 1)["text"].alias("first_a"),
        F.element_at("history_b", -1)["text"].alias("last_b"),
    )


@query("vote_eligible_sessions", f"""WITH m AS ({SESSION_PAIRS}),
p AS (SELECT chat_session_id, bool_or(side='A' AND role='assistant') AS oa, bool_or(side='B' AND role='assistant') AS ob,
 arg_max(role, turn) FILTER (side='A') AS la, arg_max(role, turn) FILTER (side='B') AS lb FROM m GROUP BY chat_session_id)
SELECT chat_session_id FROM p WHERE oa AND ob AND la <> 'user' AND lb <> 'user'""")
def vote_eligible_sessions(spark, sf):
    m = session_messages(spark, sf)

    def last_role(side):
        return F.max_by(F.when(F.col("side") == side, F.col("role")), F.when(F.col("side") == side, F.col("turn")))

    state = m.groupBy("chat_session_id").agg(
        *[F.bool_or((F.col("side") == s) & (F.col("role") == "assistant")).alias(f"has_output_{s.lower()}") for s in "AB"],
        *[F.coalesce(last_role(s) == "user", F.lit(True)).alias(f"generating_{s.lower()}") for s in "AB"],
    )
    return ops.eligible_for_vote(state).select("chat_session_id")
