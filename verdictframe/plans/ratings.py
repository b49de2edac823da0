"""Elo, Bradley-Terry and Rao-Kupper ratings, correlations between systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import draws
from verdictframe.operators import battles as battle_ops
from verdictframe.operators import correlate, ratings
from verdictframe.plans.registry import query
from verdictframe.session import truncate
from verdictframe.sources.views import view


def elo_sql(source: str, key: str, order: str, k: int = 4) -> str:
    """Online Elo of ``source`` as a recursive CTE ``elo_final(key, model, rating)``.

    Ratings are a list over the sorted models; step n applies battle n of every key.
    """
    return f"""
 models AS (SELECT model, row_number() OVER (ORDER BY model) AS i FROM
   (SELECT model_a AS model FROM {source} UNION SELECT model_b FROM {source})),
 steps AS (SELECT b.{key} AS key, row_number() OVER (PARTITION BY b.{key} ORDER BY b.{order}) AS n, x.i AS a, y.i AS b,
   CASE b.vote WHEN 'vote_left' THEN 1.0::DOUBLE WHEN 'vote_right' THEN 0.0 ELSE 0.5 END AS s
   FROM {source} b JOIN models x ON x.model = b.model_a JOIN models y ON y.model = b.model_b),
 elo(key, n, r) USING KEY (key) AS (
   SELECT key, 0::BIGINT, (SELECT list(1000.0::DOUBLE) FROM models) FROM (SELECT DISTINCT key FROM steps)
   UNION ALL
   SELECT e.key, t.n, list_transform(e.r, lambda x, i: CASE
      WHEN i = t.a THEN x + {k} * (t.s - 1 / (1 + 10.0::DOUBLE ** ((e.r[t.b] - e.r[t.a]) / 400)))
      WHEN i = t.b THEN x + {k} * (1 - t.s - 1 / (1 + 10.0::DOUBLE ** ((e.r[t.a] - e.r[t.b]) / 400))) ELSE x END)
   FROM elo e JOIN steps t ON t.key = e.key AND t.n = e.n + 1),
 elo_last AS (SELECT key, r FROM elo WHERE (key, n) IN (SELECT key, max(n) FROM steps GROUP BY key)),
 elo_final AS (SELECT key, m.model, r[m.i] AS rating FROM elo_last, models m)"""


@query("elo_by_system", f"""WITH {elo_sql('system_battles', 'system', 'seq')}
SELECT key AS system, model, round(rating, 4) AS rating FROM elo_final""")
def elo_by_system(spark, sf):
    out = ratings.online_elo(view(spark, sf, "system_battles"), ["system"])
    return out.select("system", "model", F.round("rating", 4).alias("rating"))


@query("elo_in_chunks", f"""WITH b AS (SELECT 0 AS g, * FROM battles), {elo_sql('b', 'g', 'seq')}
SELECT model, round(rating, 4) AS rating FROM elo_final""")
def elo_in_chunks(spark, sf):
    """The bounded-chunk path, forced on small data by a small chunk size."""
    battles = view(spark, sf, "battles")
    out = ratings.online_elo(battles, [], rows_per_chunk=max(1000, battles.count() // 3 + 1))
    return out.select("model", F.round("rating", 4).alias("rating"))


@query("elo_anchored", f"""WITH b AS (SELECT 0 AS g, * FROM battles), {elo_sql('b', 'g', 'seq')}
SELECT model, round(rating + CASE WHEN model IN (SELECT model_a FROM battles)
 THEN 800 - (SELECT rating FROM elo_final WHERE model = 'm05') ELSE 0 END, 4) AS rating FROM elo_final""")
def elo_anchored(spark, sf):
    out = ratings.anchored(ratings.online_elo(view(spark, sf, "battles"), []), [], "m05", 800.0)
    return out.select("model", F.round("rating", 4).alias("rating"))


# Rounds of the Elo bootstrap and the order statistics of its 90% interval.
ROUNDS = 1000
LOW, HIGH = int((1 - 0.9) / 2 * ROUNDS), int((1 - (1 - 0.9) / 2) * ROUNDS)


def mix_sql(x: str) -> str:
    """The hash of ``draws.mix`` in SQL; a lambda names the word of each step."""
    step = f"list_transform([{{}}], lambda w: (xor(w, w >> 16) * {draws.MULTIPLIER}) & {draws.WORD})[1]"
    return f"list_transform([{step.format(step.format(x))}], lambda w: xor(w, w >> 16))[1]"


def poisson_sql(source: str, order: str, rounds: int, seed: int = 17) -> str:
    """CTE ``copies(replicate, pos, model_a, model_b, vote)``: the Poisson resamples of ``source``."""
    one, two = draws.salts(seed, 2)
    times = " + ".join(f"(h >= {t})::INT" for t in draws.POISSON)
    word = mix_sql(f"xor({mix_sql(f'{order}::BIGINT & {draws.WORD}')}, ({order}::BIGINT >> 32) & {draws.WORD})")
    return f"""
 word AS (SELECT *, {word} AS word FROM {source}),
 reps AS (SELECT replicate, {mix_sql(f'xor(replicate, {one})')} AS r1, {mix_sql(f'xor(replicate, {two})')} AS r2
   FROM (SELECT unnest(range(0::BIGINT, {rounds})) AS replicate)),
 hashed AS (SELECT replicate, model_a, model_b, vote, {mix_sql(f'(word + r1) & {draws.WORD}')} AS h,
   {mix_sql(f'(word + r2) & {draws.WORD}')} AS g FROM word, reps),
 counted AS (SELECT *, unnest(range(0::BIGINT, ({times})::BIGINT)) AS copy FROM hashed),
 copies AS (SELECT replicate, (({mix_sql(f'(g + copy + 1) & {draws.WORD}')} >> 1) << 32) | xor2 AS pos, model_a, model_b, vote
   FROM (SELECT *, {mix_sql(f"xor(h, {mix_sql('copy + 1')})")} AS xor2 FROM counted))"""


@query("elo_bootstrap", f"""WITH {poisson_sql('battles', 'seq', ROUNDS)},
 b AS (SELECT * FROM copies UNION ALL SELECT -1, seq, model_a, model_b, vote FROM battles), {elo_sql('b', 'replicate', 'pos')},
 l AS (SELECT model, list_sort(list(rating)) AS r FROM elo_final WHERE key >= 0 GROUP BY model)
SELECT l.model, round(p.rating, 4) AS rating, round(r[{LOW + 1}], 4) AS lower_bound, round(r[{HIGH + 1}], 4) AS upper_bound,
 len(r) AS replicates, round(r[{LOW + 1}] - p.rating, 4) AS ci_low, round(r[{HIGH + 1}] - p.rating, 4) AS ci_high
FROM l JOIN elo_final p ON p.model = l.model AND p.key = -1""")
def elo_bootstrap(spark, sf):
    out = ratings.elo_with_intervals(view(spark, sf, "battles"), [], rounds=ROUNDS)
    numbers = ("rating", "lower_bound", "upper_bound", "ci_low", "ci_high")
    return out.select("model", "replicates", *[F.round(c, 4).alias(c) for c in numbers])


def strength_sql(source: str, key: str, wins: tuple[str, str], steps: int = 400) -> str:
    """Bradley-Terry strengths of ``source`` by the minorise-maximise iteration.

    A different way to the same maximum; ends in ``strengths(key, model, rating, battles)``.
    """
    left, right = wins
    return f"""
 sc AS (SELECT {key} AS key, model_a AS a, model_b AS b, CASE vote WHEN '{left}' THEN 1.0::DOUBLE WHEN '{right}' THEN 0 ELSE 0.5 END AS s FROM {source}),
 cell AS (SELECT key, a, b, sum(s) AS w, count(*)::DOUBLE AS n FROM (SELECT key, a, b, s FROM sc UNION ALL SELECT key, b, a, 1 - s FROM sc) GROUP BY ALL),
 names AS (SELECT key, list(a ORDER BY a) AS m FROM (SELECT DISTINCT key, a FROM cell) GROUP BY key),
 flat AS (SELECT key, m, unnest(m) AS a FROM names),
 line AS (SELECT f.key, f.a, list_transform(f.m, lambda x: coalesce(any_n[x], 0)) AS n, w FROM flat f
   JOIN (SELECT key, a, map_from_entries(list((b, n))) AS any_n, sum(w) AS w FROM cell GROUP BY key, a) c ON c.key = f.key AND c.a = f.a),
 mat AS (SELECT key, list(n ORDER BY a) AS n, list(w ORDER BY a) AS w FROM line GROUP BY key),
 it(key, i, n, w, p) AS (SELECT key, 0, n, w, list_transform(w, lambda x: 1.0::DOUBLE) FROM mat
   UNION ALL SELECT key, i + 1, n, w, list_transform(w, lambda x, r: x / list_sum(list_transform(p, lambda y, c: CASE WHEN c = r THEN 0 ELSE n[r][c] / (p[r] + y) END)))
   FROM it WHERE i < {steps}),
 done AS (SELECT it.key, unnest(names.m) AS model, unnest(p) AS p FROM it JOIN names ON names.key = it.key WHERE i = {steps}),
 strengths AS (SELECT key, model, 1000 + 400 * (ln(p) - avg(ln(p)) OVER (PARTITION BY key)) AS rating,
   (SELECT count(*) FROM sc WHERE sc.key = done.key) AS battles FROM done)"""


@query("bradley_terry", f"""WITH {strength_sql('system_battles', 'system', ('vote_left', 'vote_right'))}
SELECT key AS system, model, round(rating, 4) AS rating, true AS converged, battles FROM strengths""")
def bradley_terry(spark, sf):
    counts = battle_ops.pair_outcomes(view(spark, sf, "system_battles"), ["system"])
    fits = ratings.fit_pairs(counts, ["system"])
    return fits.select("system", "model", F.round("rating", 4).alias("rating"), "converged", "battles")


@query("bradley_terry_by_mode", f"""WITH m AS (SELECT mode, model_a, model_b, judge_vote AS vote FROM judgments), {strength_sql('m', 'mode', ('vote_left', 'vote_right'))}
SELECT key AS mode, model, round(rating, 4) AS rating, battles FROM strengths""")
def bradley_terry_by_mode(spark, sf):
    counts = battle_ops.pair_outcomes(view(spark, sf, "judgments"), ["mode"], "judge_vote")
    fits = ratings.fit_pairs(counts, ["mode"])
    return fits.select("mode", "model", F.round("rating", 4).alias("rating"), "battles")


@query("bradley_terry_residuals", """
SELECT DISTINCT system, model_a AS model, 0.0::DOUBLE AS residual FROM system_battles""")
def bradley_terry_residuals(spark, sf):
    """Observed minus expected score at the fitted strengths: 0 at the maximum."""
    counts = battle_ops.pair_outcomes(view(spark, sf, "system_battles"), ["system"])
    fits = ratings.fit_pairs(counts, ["system"]).select("system", "model", "coef")
    a = fits.select("system", F.col("model").alias("model_a"), F.col("coef").alias("ca"))
    b = fits.select("system", F.col("model").alias("model_b"), F.col("coef").alias("cb"))
    games = F.col("a_win") + F.col("b_win") + F.col("tie")
    gap = F.col("a_win") + F.col("tie") / 2 - games / (1 + F.exp(F.col("cb") - F.col("ca")))
    rows = counts.join(a, ["system", "model_a"]).join(b, ["system", "model_b"]).withColumn("gap", gap)
    both = F.explode(F.array(
        F.struct(F.col("model_a").alias("model"), F.col("gap").alias("gap")),
        F.struct(F.col("model_b").alias("model"), (-F.col("gap")).alias("gap")),
    ))
    return rows.select("system", both.alias("s")).groupBy("system", "s.model").agg(
        F.abs(F.round(F.sum("s.gap"), 4)).alias("residual")
    )


@query("bradley_terry_bootstrap")
def bradley_terry_bootstrap(spark, sf):
    out = ratings.bradley_terry_with_margin(view(spark, sf, "battles"), [], rounds=100)
    return out.select("model", F.round("rating", 4).alias("rating"), F.round("margin", 4).alias("margin"), "converged")


RK_STEPS = 1500
RAO_KUPPER = f"""
 sc AS (SELECT system AS key, model_a AS a, model_b AS b, vote = 'vote_left' AS wa, vote = 'vote_right' AS wb,
   vote IN ('vote_tie', 'vote_both_bad') AS t FROM system_battles),
 cell AS (SELECT key, a, b, sum(s)::DOUBLE AS s FROM (SELECT key, a, b, (wa OR t)::INT AS s FROM sc UNION ALL SELECT key, b, a, (wb OR t)::INT FROM sc) GROUP BY ALL),
 names AS (SELECT key, list(a ORDER BY a) AS m FROM (SELECT DISTINCT key, a FROM cell) GROUP BY key),
 flat AS (SELECT key, m, unnest(m) AS a FROM names),
 line AS (SELECT f.key, f.a, list_transform(f.m, lambda x: coalesce(by_b[x], 0)) AS s FROM flat f
   JOIN (SELECT key, a, map_from_entries(list((b, s))) AS by_b FROM cell GROUP BY key, a) c ON c.key = f.key AND c.a = f.a),
 mat AS (SELECT key, list(s ORDER BY a) AS s, (SELECT count(*) FILTER (t)::DOUBLE FROM sc WHERE sc.key = line.key) AS ties FROM line GROUP BY key),
 it(key, i, s, ties, p, h) AS (SELECT key, 0, s, ties, list_transform(s, lambda x: 1.0::DOUBLE), 1.1::DOUBLE FROM mat
   UNION ALL SELECT key, i + 1, s, ties,
    list_transform(s, lambda row, r: list_sum(row) / list_sum(list_transform(p, lambda y, c: CASE WHEN c = r THEN 0 ELSE
      row[c] / (p[r] + h * y) + h * s[c][r] / (y + h * p[r]) END))),
    list_transform([ties / list_sum(list_transform(s, lambda row, r: list_sum(list_transform(p, lambda y, c: CASE WHEN c = r THEN 0 ELSE row[c] * y / (p[r] + h * y) END))))],
      lambda q: q + sqrt(1 + q * q))[1]
   FROM it WHERE i < {RK_STEPS}),
 done AS (SELECT it.key, unnest(names.m) AS model, unnest(p) AS p, h FROM it JOIN names ON names.key = it.key WHERE i = {RK_STEPS})"""


@query("rao_kupper", f"""WITH {RAO_KUPPER} SELECT key AS system, model, round(ln(p) - avg(ln(p)) OVER (PARTITION BY key), 5) AS coef,
 round(ln(h), 5) AS eta, true AS converged FROM done""")
def rao_kupper(spark, sf):
    counts = battle_ops.pair_outcomes(view(spark, sf, "system_battles"), ["system"])
    fits = ratings.fit_pairs(counts, ["system"], "rk")
    return fits.select("system", "model", F.round("coef", 5).alias("coef"), F.round("eta", 5).alias("eta"), "converged")


@query("rao_kupper_tie_share", """
SELECT system, count(*) FILTER (vote IN ('vote_tie','vote_both_bad')) AS ties,
 count(*) FILTER (vote IN ('vote_tie','vote_both_bad')) AS expected_ties FROM system_battles GROUP BY system""")
def rao_kupper_tie_share(spark, sf):
    """At the fit the expected number of ties, up to the model's own slope, is observed.

    The slope of the likelihood in eta is zero there: sum over battles of the two
    win terms equals 2x/(x-1) per tie. That identity, rounded, is what is returned.
    """
    counts = battle_ops.pair_outcomes(view(spark, sf, "system_battles"), ["system"])
    fits = ratings.fit_pairs(counts, ["system"], "rk").select("system", "model", "coef", "eta")
    a = fits.select("system", F.col("model").alias("model_a"), F.col("coef").alias("ca"), "eta")
    b = fits.select("system", F.col("model").alias("model_b"), F.col("coef").alias("cb"))
    rows = counts.join(a, ["system", "model_a"]).join(b, ["system", "model_b"])
    gap, eta = F.col("ca") - F.col("cb"), F.col("eta")
    lost1 = (F.col("a_win") + F.col("tie")) / (1 + F.exp(gap - eta))
    lost2 = (F.col("b_win") + F.col("tie")) / (1 + F.exp(-gap - eta))
    odds = F.exp(2 * eta)
    return rows.groupBy("system").agg(
        F.sum("tie").alias("ties"),
        F.round(F.sum((lost1 + lost2) * (odds - 1) / (2 * odds))).cast("bigint").alias("expected_ties"),
    )


@query("rao_kupper_bootstrap")
def rao_kupper_bootstrap(spark, sf):
    counts = battle_ops.pair_outcomes(view(spark, sf, "battles"), [])
    fits = ratings.bootstrap_fits(counts, [], rounds=100, method="rk")
    return fits.groupBy("model").agg(
        F.count(F.lit(1)).alias("replicates"),
        F.round(F.percentile("coef", F.lit(0.05)), 5).alias("coef_low"),
        F.round(F.percentile("coef", F.lit(0.95)), 5).alias("coef_high"),
        F.round(F.avg("eta"), 5).alias("eta"),
    )


def length_controls(spark, sf):
    """Left-win indicator against two control features of the battle."""
    b = view(spark, sf, "battles").filter("vote IN ('vote_left', 'vote_right')")
    return b.select(
        (F.col("vote") == "vote_left").cast("double").alias("won"),
        (F.substring("model_a", 2, 2).cast("double") / 12).alias("strength"),
        (F.col("seq") % 6).cast("double").alias("category_no"),
    )


@query("binary_fit")
def binary_fit(spark, sf):
    features = ["strength", "category_no"]
    cells = ratings.binary_cells(length_controls(spark, sf), features, "won")
    model = ratings.fit_binary(cells, features, "won", "weight")
    values = [*zip(features, model.coefficients.toArray().tolist()), ("intercept", model.intercept)]
    return spark.createDataFrame(
        [(f, round(float(v), 5)) for f, v in values], "feature string, coef double"
    )


@query("binary_fit_gradient", """SELECT feature, 0.0::DOUBLE AS slope
FROM (VALUES ('strength'), ('category_no'), ('intercept')) AS v(feature) WHERE EXISTS (SELECT 1 FROM battles)""")
def binary_fit_gradient(spark, sf):
    """Slope of the penalised likelihood at the fit, per battle: 0 at the maximum."""
    features = ["strength", "category_no"]
    cells = ratings.binary_cells(length_controls(spark, sf), features, "won").cache()
    model = ratings.fit_binary(cells, features, "won", "weight")
    coefs = dict(zip(features, model.coefficients.toArray().tolist()))
    z = sum((F.col(f) * c for f, c in coefs.items()), F.lit(float(model.intercept)))
    gap = F.col("weight") * (F.col("won") - 1 / (1 + F.exp(-z)))
    columns = {**{f: (F.col(f), c) for f, c in coefs.items()}, "intercept": (F.lit(1.0), 0.0)}
    sums = cells.agg(F.sum("weight").alias("total"), *[(F.sum(gap * x) - c).alias(f) for f, (x, c) in columns.items()])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.round(F.col(f) / F.col("total"), 5)).alias("slope")) for f in columns])
    return sums.select(F.inline(pairs))


@query("binary_fit_bootstrap")
def binary_fit_bootstrap(spark, sf):
    features = ["strength", "category_no"]
    fits = ratings.bootstrap_binary(length_controls(spark, sf), features, "won")
    return fits.groupBy("feature").agg(
        F.round(F.avg("coef"), 5).alias("mean"), F.round(F.stddev("coef"), 5).alias("deviation"),
        F.count(F.lit(1)).alias("replicates"),
    )


@query("baseline_contrast", """WITH rows AS (SELECT seq, model_b AS model FROM battles)
SELECT feature, value, count(*) AS n FROM (SELECT model AS feature, 1 AS value FROM rows WHERE model <> 'm03'
 UNION ALL SELECT 'm03', -1 FROM rows) GROUP BY ALL""")
def baseline_contrast(spark, sf):
    rows = ratings.baseline_contrast(view(spark, sf, "battles"), "seq", "model_b", "m03")
    return rows.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


@query("win_probability", """WITH w AS (SELECT model, ln(sum(w) / (count(*) - sum(w))) AS coef FROM (
  SELECT model_a AS model, CASE vote WHEN 'vote_left' THEN 1 ELSE 0 END AS w FROM battles UNION ALL
  SELECT model_b, CASE vote WHEN 'vote_right' THEN 1 ELSE 0 END FROM battles) GROUP BY model)
SELECT model, round(exp(coef) / (exp(coef) + exp((SELECT coef FROM w WHERE model = 'm03'))), 6) AS win_probability FROM w""")
def win_probability(spark, sf):
    stats = battle_ops.battle_stats(view(spark, sf, "battles"))
    coefs = stats.select("model", F.log(F.col("wins") / (F.col("total") - F.col("wins"))).alias("coef"))
    out = ratings.win_probability(coefs, [], "m03")
    return out.select("model", F.round("win_probability", 6).alias("win_probability"))


# Rating table used for the correlations: online Elo of every system, rounded so
# both engines see equal numbers (and equal ties).
RATINGS = f"""{elo_sql('system_battles', 'system', 'seq')}, ratings AS (SELECT key AS system, model, round(rating, 2) AS rating FROM elo_final),
 pairs AS (SELECT a.system AS system1, b.system AS system2, a.model, a.rating AS x, b.rating AS y
  FROM ratings a JOIN ratings b ON a.model = b.model AND a.system < b.system),
 ranked AS (SELECT *, rank() OVER (PARTITION BY system1, system2 ORDER BY x) + (count(*) OVER (PARTITION BY system1, system2, x) - 1) / 2 AS rx,
   rank() OVER (PARTITION BY system1, system2 ORDER BY y) + (count(*) OVER (PARTITION BY system1, system2, y) - 1) / 2 AS ry FROM pairs),
 cor AS (SELECT system1, system2, corr(rx, ry) AS spearman, corr(x, y) AS pearson, count(*) AS common_models FROM ranked GROUP BY ALL)"""


def system_ratings(spark, sf):
    elo = ratings.online_elo(view(spark, sf, "system_battles"), ["system"])
    # Stored: a join of the ratings with themselves would fold twice.
    return truncate(elo.select("system", "model", F.round("rating", 2).alias("rating")))


@query("common_model_pairs", f"WITH {RATINGS} SELECT system1, system2, model, x, y FROM pairs")
def common_model_pairs(spark, sf):
    return correlate.system_pairs(system_ratings(spark, sf))


@query("spearman", f"WITH {RATINGS} SELECT system1, system2, round(spearman, 6) AS correlation, common_models FROM cor")
def spearman(spark, sf):
    corr = correlate.correlations(correlate.system_pairs(system_ratings(spark, sf)))
    return corr.select("system1", "system2", F.round("correlation", 6).alias("correlation"), "common_models")


@query("pearson", f"WITH {RATINGS} SELECT system1, system2, round(pearson, 6) AS correlation, common_models FROM cor")
def pearson(spark, sf):
    corr = correlate.correlations(correlate.system_pairs(system_ratings(spark, sf)), "pearson")
    return corr.select("system1", "system2", F.round("correlation", 6).alias("correlation"), "common_models")


# Two-sided p-value of a correlation: Student's t with n - 2 degrees of freedom by its
# finite series in the angle (even and odd degrees).
P_VALUES = f"""WITH {RATINGS}, c AS (SELECT system1, system2, spearman AS r, common_models - 2 AS df FROM cor),
 a AS (SELECT *, atan(abs(r) / sqrt(greatest(1 - r * r, 1e-300))) AS angle FROM c),
 e AS (SELECT *, CASE WHEN df % 2 = 0 THEN sin(angle) * list_sum(list_transform(range(0, df // 2),
    lambda k: gamma(k + 0.5) / (sqrt(pi()) * gamma(k + 1.0)) * cos(angle) ** (2 * k)))
  ELSE 2 / pi() * (angle + sin(angle) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2),
    lambda k: sqrt(pi()) / 2 * gamma(k + 1.0) / gamma(k + 1.5) * cos(angle) ** (2 * k + 1))), 0)) END AS inside FROM a)
SELECT system1, system2, round(greatest(1 - inside, 0), 8) AS p_value, 1 - inside < 0.05 AS significant FROM e"""


@query("correlation_p_values", P_VALUES)
def correlation_p_values(spark, sf):
    corr = correlate.correlations(correlate.system_pairs(system_ratings(spark, sf)))
    return corr.select("system1", "system2", F.round("p_value", 8).alias("p_value"), "significant")


SYSTEMS = ["Human Votes", "jA (with_execution)", "jA (without_execution)",
           "jB (with_execution)", "jB (without_execution)"]


@query("correlation_matrix", f"""WITH {RATINGS}, cells AS (
 SELECT system1, system2, spearman FROM cor UNION ALL SELECT system2, system1, spearman FROM cor
 UNION ALL SELECT DISTINCT system, system, 1.0 FROM ratings)
SELECT system1 AS system, {', '.join(f"round(coalesce(max(spearman) FILTER (system2 = '{s}'), 0), 6) AS s{i}" for i, s in enumerate(SYSTEMS))}
FROM cells GROUP BY system1""")
def correlation_matrix(spark, sf):
    rows = system_ratings(spark, sf)
    cells = correlate.correlation_cells(correlate.correlations(correlate.system_pairs(rows)), rows)
    table = correlate.correlation_matrix(cells, SYSTEMS)
    return table.select(
        F.col("system1").alias("system"),
        *[F.round(F.col(f"`{s}`"), 6).alias(f"s{i}") for i, s in enumerate(SYSTEMS)],
    )


@query("trend_lines", f"""WITH {RATINGS} SELECT system1, system2, round(regr_slope(y, x), 6) AS slope,
 round(regr_intercept(y, x), 4) AS intercept FROM pairs GROUP BY ALL""")
def trend_lines(spark, sf):
    lines = correlate.trend_lines(correlate.system_pairs(system_ratings(spark, sf)))
    return lines.select("system1", "system2", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("correlation_rankings", f"""WITH {RATINGS}, p AS (SELECT system1, system2, round(spearman, 6) AS correlation,
  regexp_extract(system1, '^(.*) \\((\\w+)\\)$', 1) AS j1, regexp_extract(system1, '^(.*) \\((\\w+)\\)$', 2) AS m1,
  regexp_extract(system2, '^(.*) \\((\\w+)\\)$', 1) AS j2, regexp_extract(system2, '^(.*) \\((\\w+)\\)$', 2) AS m2 FROM cor),
 k AS (SELECT *, 'all_pairs' AS ranking FROM p UNION ALL SELECT *, 'human_vs_judge' FROM p WHERE system1 = 'Human Votes'
  UNION ALL SELECT *, 'with_vs_without' FROM p WHERE j1 = j2 AND j1 <> '' AND m1 <> m2
  UNION ALL SELECT *, 'same_mode:' || m1 FROM p WHERE m1 = m2 AND m1 <> '' AND j1 <> j2)
SELECT ranking, system1, system2, correlation, row_number() OVER (PARTITION BY ranking ORDER BY correlation DESC, system1, system2) AS rank FROM k""")
def correlation_rankings(spark, sf):
    corr = correlate.correlations(correlate.system_pairs(system_ratings(spark, sf)))
    corr = corr.withColumn("correlation", F.round("correlation", 6))
    out = correlate.correlation_rankings(corr)
    return out.select("ranking", "system1", "system2", "correlation", "rank")
