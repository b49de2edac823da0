"""Battles: normalisation, counts per pair, per model and per system."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions.predicates import all_present, present, vote_of, winner_of

LEFT_WIN = ("vote_left", "model_a")
RIGHT_WIN = ("vote_right", "model_b")
TIES = ("vote_tie", "vote_both_bad", "tie", "tie (bothbad)")


def human_battles(records: DataFrame) -> DataFrame:
    """Battles from raw votes: every required field present, vote in vocabulary.

    Only ``human_vote`` counts and sessions are not de-duplicated.
    """
    return records.filter(
        all_present("chat_session_id", "model_a", "model_b", "human_vote")
    ).withColumn("vote", vote_of("human_vote")).filter(F.col("vote").isNotNull())


def human_votes_latest(records: DataFrame, order: str = "seq") -> DataFrame:
    """One vote per session, the last one; falls back to ``vote_type``."""
    raw = F.when(present("human_vote"), F.col("human_vote")).otherwise(F.col("vote_type"))
    votes = records.filter(present("chat_session_id")).withColumn("vote", vote_of(raw)).filter(
        F.col("vote").isNotNull()
    )
    packed = F.struct(
        F.col("vote"),
        F.coalesce(F.col("category_name"), F.lit("unknown")).alias("category_name"),
        raw.alias("original_vote"),
    )
    return votes.groupBy("chat_session_id").agg(F.max_by(packed, order).alias("v")).select(
        "chat_session_id", "v.*"
    )


def vote_conversion_tally(records: DataFrame, raw: str = "human_vote") -> DataFrame:
    """How many raw votes became which label."""
    return (
        records.select(F.col(raw).alias("raw_vote"), vote_of(raw).alias("vote"))
        .filter(F.col("vote").isNotNull())
        .groupBy("raw_vote", "vote")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def winners(votes: DataFrame) -> DataFrame:
    """left/right/tie/both_bad votes as winners; other votes are skipped."""
    return votes.withColumn("winner", winner_of("vote")).filter(F.col("winner").isNotNull())


def sides(battles: DataFrame, keys: list[str], outcome: str = "vote") -> DataFrame:
    """Two rows per battle: each model with its own result."""

    def row(model: str, wins: tuple, losses: tuple) -> Column:
        result = (
            F.when(F.col(outcome).isin(*wins), "win")
            .when(F.col(outcome).isin(*losses), "loss")
            .when(F.col(outcome).isin(*TIES), "tie")
        )
        return F.struct(F.col(model).alias("model"), result.alias("result"))

    both = F.array(row("model_a", LEFT_WIN, RIGHT_WIN), row("model_b", RIGHT_WIN, LEFT_WIN))
    return battles.select(*keys, F.explode(both).alias("side")).select(*keys, "side.*")


def battle_stats(battles: DataFrame, keys: list[str] = (), outcome: str = "vote") -> DataFrame:
    """Wins, ties, losses and their rates per model (and key).

    The explode feeds a map-side partial aggregate, so what is shuffled is one
    row per model and task, whatever the battle count or its skew.
    """
    keys = list(keys)
    agg = (
        sides(battles, keys, outcome)
        .groupBy(*keys, "model")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("result") == "win").alias("wins"),
            F.count_if(F.col("result") == "tie").alias("ties"),
            F.count_if(F.col("result") == "loss").alias("losses"),
        )
    )
    for part, rate in (("wins", "win_rate"), ("ties", "tie_rate"), ("losses", "loss_rate")):
        agg = agg.withColumn(rate, F.col(part) / F.col("total"))
    return agg


def vote_counts(battles: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Battles per model, over both seats."""
    keys = list(keys)
    return (
        battles.select(*keys, F.explode(F.array("model_a", "model_b")).alias("model"))
        .groupBy(*keys, "model")
        .agg(F.count(F.lit(1)).alias("votes"))
    )


def pair_outcomes(battles: DataFrame, keys: list[str] = (), outcome: str = "vote") -> DataFrame:
    """Outcome counts per ordered model pair."""
    o = F.col(outcome)
    return battles.groupBy(*keys, "model_a", "model_b").agg(
        F.count_if(o.isin(*LEFT_WIN)).alias("a_win"),
        F.count_if(o.isin(*RIGHT_WIN)).alias("b_win"),
        F.count_if(o.isin(*TIES)).alias("tie"),
    )


def system_stats(battles: DataFrame) -> DataFrame:
    """Battles and distinct models per system."""
    per_model = (
        battles.select("system", F.explode(F.array("model_a", "model_b")).alias("model"))
        .groupBy("system", "model")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_model.groupBy("system").agg(
        (F.sum("n") / 2).cast("bigint").alias("total_battles"),
        F.count(F.lit(1)).alias("unique_models"),
    )


def vote_distribution(battles: DataFrame) -> DataFrame:
    return battles.groupBy("system", "vote").agg(F.count(F.lit(1)).alias("n"))


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last row per key.

    ``max_by`` combines on the map side, so a key with a third of all rows costs
    one row per task in the shuffle. ``order`` must be unique within a key.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def earliest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key, by the same map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Position 1..n per key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_per_class(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per class; Spark limits each class before its shuffle."""
    return ranked(df, keys, order, "position").filter(F.col("position") <= k)


def pair_sessions(messages: DataFrame) -> DataFrame:
    """One row per battle from the two one-sided conversations of a session.

    ``messages(chat_session_id, side, turn, role, text)``; both histories become
    ordered arrays next to each other.
    """

    def history(side: str) -> Column:
        packed = F.when(
            F.col("side") == side, F.struct("turn", "role", "text")
        )
        return F.array_sort(F.collect_list(packed))

    return messages.groupBy("chat_session_id").agg(
        history("A").alias("history_a"), history("B").alias("history_b")
    ).filter((F.size("history_a") > 0) & (F.size("history_b") > 0))


def eligible_for_vote(sessions: DataFrame) -> DataFrame:
    """Both sides have an output and neither is still generating."""
    ok = [
        F.coalesce(F.col(f"has_output_{s}"), F.lit(False))
        & ~F.coalesce(F.col(f"generating_{s}"), F.lit(False))
        for s in ("a", "b")
    ]
    return sessions.filter(ok[0] & ok[1])
