"""Leaderboards by topic, bootstrap intervals and rank tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.operators import battles
from verdictframe.operators import leaderboard as ops
from verdictframe.operators import ratings as rating_ops
from verdictframe.plans.ratings import strength_sql
from verdictframe.plans.registry import query
from verdictframe.sources.views import view

TOPICS = [f"cat{i}" for i in range(6)]
SCORE_CASE = """CASE {c} WHEN 'A>B' THEN [1.0::DOUBLE] WHEN 'A>>B' THEN [1.0::DOUBLE,1.0,1.0] WHEN 'A=B' THEN [0.5::DOUBLE]
 WHEN 'B>A' THEN [0.0::DOUBLE] WHEN 'B>>A' THEN [0.0::DOUBLE,0.0,0.0] END"""
POINTS = f"""points AS (SELECT uid, model, topic, unnest(list_concat({SCORE_CASE.format(c='score2')},
  list_transform({SCORE_CASE.format(c='score1')}, lambda s: 1 - s))) AS score
 FROM games WHERE score1 IS NOT NULL AND score2 IS NOT NULL)"""
SLICED = f"""{POINTS}, sliced AS (SELECT topic AS slice, model, score FROM points UNION ALL SELECT 'Overall', model, score FROM points)"""


def points(spark, sf):
    games = view(spark, sf, "games").withColumn(
        "games", F.array(F.struct(F.col("score1").alias("score")), F.struct(F.col("score2").alias("score")))
    )
    return ops.score_rows(ops.complete_games(games).drop("games"), "score1", "score2")


def sliced_cells(spark, sf):
    return ops.score_cells(points(spark, sf), "topic")


@query("complete_games", """SELECT uid, model, topic, score1, score2 FROM games WHERE score1 IS NOT NULL AND score2 IS NOT NULL""")
def complete_games(spark, sf):
    games = view(spark, sf, "games").withColumn(
        "games", F.array(F.struct(F.col("score1").alias("score")), F.struct(F.col("score2").alias("score")))
    )
    return ops.complete_games(games).drop("games")


@query("score_points", f"WITH {POINTS} SELECT model, score, count(*) AS n FROM points GROUP BY ALL")
def score_points(spark, sf):
    return points(spark, sf).groupBy("model", "score").agg(F.count(F.lit(1)).alias("n"))


@query("points_by_category", f"""WITH {POINTS}, c AS (SELECT uid, any_value(category) AS topic FROM
 (SELECT seq AS uid, category FROM battles WHERE category <> 'cat5') GROUP BY uid)
SELECT c.topic, count(*) AS n, round(avg(score), 6) AS score FROM points JOIN c USING (uid) GROUP BY c.topic""")
def points_by_category(spark, sf):
    known = view(spark, sf, "battles").filter("category <> 'cat5'").select(
        F.col("seq").alias("uid"), "seq", F.col("category").alias("topic")
    )
    categories = battles.latest(known, ["uid"], "seq").select("uid", "topic")
    rows = ops.with_category(points(spark, sf).drop("topic"), categories)
    return rows.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("score")
    )


@query("mean_scores_by_topic", f"WITH {SLICED} SELECT slice, model, round(avg(score), 6) AS score FROM sliced GROUP BY ALL")
def mean_scores_by_topic(spark, sf):
    return ops.mean_scores(sliced_cells(spark, sf)).select("slice", "model", F.round("score", 6).alias("score"))


@query("score_table", f"""WITH {SLICED} SELECT model,
 {', '.join(f"round(avg(score) FILTER (slice = '{s}') * 100, 6) AS {s.lower()}" for s in TOPICS + ['Overall'])} FROM sliced GROUP BY model""")
def score_table(spark, sf):
    table = ops.score_table(ops.mean_scores(sliced_cells(spark, sf)), TOPICS + [ops.OVERALL])
    return table.select("model", *[F.round(F.col(s) * 100, 6).alias(s.lower()) for s in TOPICS + [ops.OVERALL]])


@query("rank_table", f"""WITH {SLICED}, m AS (SELECT slice, model, round(avg(score), 6) AS score FROM sliced GROUP BY ALL),
 r AS (SELECT slice, model, rank() OVER (PARTITION BY slice ORDER BY score DESC) AS rank FROM m),
 w AS (SELECT model, {', '.join(f"max(rank) FILTER (slice = '{s}') AS {s.lower()}" for s in TOPICS + ['Overall'])} FROM r GROUP BY model)
SELECT *, row_number() OVER (ORDER BY overall NULLS LAST, model) AS position FROM w""")
def rank_table(spark, sf):
    means = ops.mean_scores(sliced_cells(spark, sf)).withColumn("score", F.round("score", 6))
    table = ops.rank_table(means, TOPICS + [ops.OVERALL])
    return table.select("model", "position", *[F.col(s).alias(s.lower()) for s in TOPICS + [ops.OVERALL]])


@query("leaderboard_bootstrap")
def leaderboard_bootstrap(spark, sf):
    """Resampled by multinomial counts; checked against row draws in the tests."""
    return ops.leaderboard(ops.bootstrap_means(sliced_cells(spark, sf), 100), "m99")


@query("leaderboard_by_draws", f"""WITH {POINTS},
 s AS (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY score) - 1 AS idx, count(*) OVER (PARTITION BY model) AS n
   FROM points WHERE score IS NOT NULL),
 d AS (SELECT model, r.round, ('0x' || substr(md5('17:Overall:' || model || ':' || r.round || ':' || idx), 1, 15))::BIGINT % n AS pick
   FROM s, (SELECT unnest(range(0, 100)) AS round) r),
 m AS (SELECT d.model, d.round, avg(s.score) AS mean FROM d JOIN s ON s.model = d.model AND s.idx = d.pick GROUP BY ALL),
 q AS (SELECT model, avg(mean) AS mean, quantile_cont(mean, 0.05) AS lo, quantile_cont(mean, 0.95) AS hi FROM m GROUP BY model)
SELECT 'Overall' AS slice, model, round(mean * 100, 1) AS score_pct, -round((mean - lo) * 100, 1) AS ci_low,
 round((hi - mean) * 100, 1) AS ci_high FROM q UNION ALL SELECT 'Overall', 'm99', 50.0, 0.0, 0.0""")
def leaderboard_by_draws(spark, sf):
    cells = ops.score_cells(points(spark, sf))
    return ops.leaderboard(ops.bootstrap_means_by_draws(cells, 100, 17), "m99")


META = """meta AS (SELECT DISTINCT model_a AS model, concat('org', right(model_a, 1)) AS organization,
 CASE WHEN model_a < 'm05' THEN 'open' ELSE 'closed' END AS license FROM battles WHERE model_a <> 'm03')"""


def metadata(spark, sf):
    models = view(spark, sf, "battles").filter("model_a <> 'm03'").select(F.col("model_a").alias("model")).distinct()
    return models.select(
        "model", F.concat(F.lit("org"), F.substring("model", -1, 1)).alias("organization"),
        F.when(F.col("model") < "m05", "open").otherwise("closed").alias("license"),
    )


@query("ranking_with_metadata", f"""WITH {META}, v AS (SELECT model, count(*) AS votes, sum(w) / count(*) AS wr FROM (
  SELECT model_a AS model, CASE vote WHEN 'vote_left' THEN 1 ELSE 0 END AS w FROM battles UNION ALL
  SELECT model_b, CASE vote WHEN 'vote_right' THEN 1 ELSE 0 END FROM battles) GROUP BY model),
 s AS (SELECT v.model, round(1000 + 400 * wr, 1) AS score, CASE WHEN v.model <> 'm01' THEN round(100 * wr, 1) END AS ci_margin, votes,
  coalesce(organization, 'Unknown') AS organization, coalesce(license, 'Unknown') AS license FROM v LEFT JOIN meta USING (model))
SELECT *, row_number() OVER (ORDER BY score DESC, model) AS rank FROM s""")
def ranking_with_metadata(spark, sf):
    stats = battles.battle_stats(view(spark, sf, "battles"))
    ratings = stats.select(
        "model", (1000 + 400 * F.col("win_rate")).alias("rating"),
        F.when(F.col("model") == "m01", 0.0).otherwise(100 * F.col("win_rate")).alias("margin"),
    )
    votes = stats.select("model", F.col("total").alias("votes"))
    return ops.ranking_frame(ratings, votes, metadata(spark, sf))


def voted_board(spark, sf):
    """Votes to pair counts to Bradley-Terry with margin to the public ranking."""
    votes = view(spark, sf, "battles")
    fitted = rating_ops.bradley_terry_with_margin(votes, [])
    counts = battles.battle_stats(votes).select("model", F.col("total").alias("votes"))
    return ops.ranking_frame(fitted.select("model", "rating", "margin"), counts, metadata(spark, sf))


@query("public_leaderboard")
def public_leaderboard(spark, sf):
    """With the bootstrap margin, whose draws come from a generator."""
    return voted_board(spark, sf)


@query("public_leaderboard_ranks", f"""WITH {META}, b AS (SELECT 0 AS g, * FROM battles), {strength_sql('b', 'g', ('vote_left', 'vote_right'))},
 v AS (SELECT model, count(*) AS votes FROM (SELECT model_a AS model FROM battles UNION ALL SELECT model_b FROM battles) GROUP BY model),
 s AS (SELECT t.model, round(t.rating, 1) AS score, votes, coalesce(organization, 'Unknown') AS organization, coalesce(license, 'Unknown') AS license
  FROM strengths t JOIN v USING (model) LEFT JOIN meta USING (model))
SELECT *, true AS has_margin, row_number() OVER (ORDER BY score DESC, model) AS rank FROM s""")
def public_leaderboard_ranks(spark, sf):
    """The same board with the margin as a flag."""
    board = voted_board(spark, sf)
    return board.withColumn("has_margin", F.col("ci_margin").isNotNull()).drop("ci_margin")
