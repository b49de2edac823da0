"""Agreement metrics of judges against human votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions.predicates import MERGED_LABELS, VOTE_LABELS
from verdictframe.operators import agreement as ops
from verdictframe.operators import battles
from verdictframe.plans.battles import HUMAN_LATEST, VOTE_CASE
from verdictframe.plans.registry import query
from verdictframe.sources.views import view

NUMBERS = ["accuracy", "macro_precision", "macro_recall", "macro_f1", "micro_precision",
           "micro_recall", "micro_f1", "cohen_kappa", "matthews_corrcoef"]

PAIRS = f"""human AS ({HUMAN_LATEST}), pairs AS (
 SELECT j.judge, j.mode, concat(j.judge, ' (', j.mode, ')') AS system, h.category_name AS category, h.vote AS truth,
  {VOTE_CASE.format(c='j.judgment')} AS guess
 FROM judge_rows j JOIN human h USING (chat_session_id) WHERE {VOTE_CASE.format(c='j.judgment')} IS NOT NULL)"""


def metric_sql(source: str, keys: str, labels: list[str]) -> str:
    """Metrics of ``source(keys, truth, guess)`` as CTEs ending in ``scores``."""
    values = ", ".join(f"('{x}')" for x in labels)
    on = " AND ".join(f"a.{k.strip()} = l.{k.strip()}" for k in keys.split(","))
    return f"""
 grp AS (SELECT {keys}, count(*)::DOUBLE AS n, count(*) FILTER (truth = guess)::DOUBLE AS hits FROM {source} GROUP BY {keys}),
 lab AS (SELECT grp.*, v.label FROM grp, (VALUES {values}) v(label)),
 cls AS (SELECT {', '.join('l.' + k.strip() for k in keys.split(','))}, l.label, l.n, l.hits,
   count(*) FILTER (a.truth = l.label AND a.guess = l.label)::DOUBLE AS tp,
   count(*) FILTER (a.truth = l.label)::DOUBLE AS t, count(*) FILTER (a.guess = l.label)::DOUBLE AS p
   FROM lab l JOIN {source} a ON {on} GROUP BY ALL),
 cm AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS prec, CASE WHEN t = 0 THEN 0 ELSE tp / t END AS rec,
   CASE WHEN t + p = 0 THEN 0 ELSE 2 * tp / (t + p) END AS f FROM cls),
 scores AS (SELECT {keys}, any_value(n)::BIGINT AS n_samples, any_value(hits) / any_value(n) AS accuracy,
   avg(prec) AS macro_precision, avg(rec) AS macro_recall, avg(f) AS macro_f1,
   CASE WHEN sum(p) = 0 THEN 0 ELSE sum(tp) / sum(p) END AS micro_precision,
   CASE WHEN sum(t) = 0 THEN 0 ELSE sum(tp) / sum(t) END AS micro_recall,
   CASE WHEN sum(t) + sum(p) = 0 THEN 0 ELSE 2 * sum(tp) / (sum(t) + sum(p)) END AS micro_f1,
   CASE WHEN sum(t * p) / (any_value(n) * any_value(n)) < 1 THEN
    (any_value(hits) / any_value(n) - sum(t * p) / (any_value(n) * any_value(n))) / (1 - sum(t * p) / (any_value(n) * any_value(n))) END AS cohen_kappa,
   CASE WHEN (any_value(n) ** 2 - sum(p * p)) * (any_value(n) ** 2 - sum(t * t)) = 0 THEN 0 ELSE
    (any_value(hits) * any_value(n) - sum(t * p)) / sqrt((any_value(n) ** 2 - sum(p * p)) * (any_value(n) ** 2 - sum(t * t))) END AS matthews_corrcoef
   FROM cm GROUP BY {keys})"""


ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in NUMBERS)
MERGED = """merged AS (SELECT * REPLACE (
 CASE WHEN truth IN ('vote_tie','vote_both_bad') THEN 'vote_uncertain' ELSE truth END AS truth,
 CASE WHEN guess IN ('vote_tie','vote_both_bad') THEN 'vote_uncertain' ELSE guess END AS guess) FROM pairs)"""


def matched(spark, sf):
    human = battles.human_votes_latest(view(spark, sf, "raw_votes"))
    pairs = ops.matched_pairs(view(spark, sf, "judge_rows"), human)
    return pairs.withColumnRenamed("category_name", "category").withColumn(
        "system", F.concat("judge", F.lit(" ("), "mode", F.lit(")"))
    )


def rounded(df, names, digits=6):
    return df.select(*[
        F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns
    ])


@query("matched_pairs", f"WITH {PAIRS} SELECT system, category, truth, guess, count(*) AS n FROM pairs GROUP BY ALL")
def matched_pairs(spark, sf):
    return ops.confusion_cells(matched(spark, sf), ["system", "category"])


@query("confusion_matrix", f"""WITH {PAIRS}, g AS (SELECT s.system, t.label AS truth, p.label AS guess
 FROM (SELECT DISTINCT system FROM pairs) s, (VALUES ('vote_left'),('vote_right'),('vote_tie'),('vote_both_bad')) t(label),
 (VALUES ('vote_left'),('vote_right'),('vote_tie'),('vote_both_bad')) p(label))
SELECT g.system, g.truth, g.guess, count(pairs.system) AS n FROM g LEFT JOIN pairs USING (system, truth, guess) GROUP BY ALL""")
def confusion_matrix(spark, sf):
    return ops.confusion_matrix(ops.confusion_cells(matched(spark, sf), ["system"]), ["system"])


@query("class_metrics", f"""WITH {PAIRS}, {metric_sql('pairs', 'system', VOTE_LABELS)}
SELECT system, label, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f, 6) AS f1,
 t::BIGINT AS support, p::BIGINT AS predicted FROM cm""")
def class_metrics(spark, sf):
    cells = ops.confusion_cells(matched(spark, sf), ["system"])
    return rounded(ops.per_class(cells, ["system"]), ["precision", "recall", "f1"])


@query("agreement_by_system", f"""WITH {PAIRS}, {metric_sql('pairs', 'system', VOTE_LABELS)}
SELECT system, n_samples, {ROUNDED} FROM scores""")
def agreement_by_system(spark, sf):
    cells = ops.confusion_cells(matched(spark, sf), ["system"])
    return rounded(ops.metrics(cells, ["system"]), NUMBERS)


@query("agreement_by_system_category", f"""WITH {PAIRS},
 leveled AS (SELECT system, category, truth, guess FROM pairs UNION ALL SELECT system, 'ALL', truth, guess FROM pairs),
 {metric_sql('leveled', 'system, category', VOTE_LABELS)}
SELECT system, category, n_samples, {ROUNDED} FROM scores""")
def agreement_by_system_category(spark, sf):
    cells = ops.confusion_cells(matched(spark, sf), ["system", "category"])
    return rounded(ops.metrics(ops.with_overall(cells, "category"), ["system", "category"]), NUMBERS)


@query("class_agreement_by_category", f"""WITH {PAIRS},
 leveled AS (SELECT system, category, truth, guess FROM pairs UNION ALL SELECT system, 'ALL', truth, guess FROM pairs),
 {metric_sql('leveled', 'system, category', VOTE_LABELS)}
SELECT system, category, label, round(rec, 6) AS agreement FROM cm""")
def class_agreement_by_category(spark, sf):
    cells = ops.with_overall(ops.confusion_cells(matched(spark, sf), ["system", "category"]), "category")
    return ops.per_class(cells, ["system", "category"]).select(
        "system", "category", "label", F.round("recall", 6).alias("agreement")
    )


@query("label_distributions", f"""WITH {PAIRS}
SELECT system, 'true' AS side, truth AS label, count(*) AS n FROM pairs GROUP BY ALL
UNION ALL SELECT system, 'predicted', guess, count(*) FROM pairs GROUP BY ALL""")
def label_distributions(spark, sf):
    return ops.label_distributions(ops.confusion_cells(matched(spark, sf), ["system"]), ["system"])


@query("merged_agreement", f"""WITH {PAIRS}, {MERGED}, {metric_sql('merged', 'system', MERGED_LABELS)}
SELECT system, n_samples, {ROUNDED} FROM scores""")
def merged_agreement(spark, sf):
    cells = ops.merged_cells(ops.confusion_cells(matched(spark, sf), ["system"]))
    return rounded(ops.metrics(cells, ["system"], MERGED_LABELS), NUMBERS)


@query("merged_gain", f"""WITH {PAIRS}, {MERGED},
 four AS (WITH {metric_sql('pairs', 'system', VOTE_LABELS)} SELECT * FROM scores),
 three AS (WITH {metric_sql('merged', 'system', MERGED_LABELS)} SELECT * FROM scores)
SELECT four.system, four.n_samples, round(four.accuracy, 6) AS accuracy, round(four.macro_f1, 6) AS macro_f1,
 round(three.accuracy, 6) AS merged_accuracy, round(three.macro_f1, 6) AS merged_macro_f1,
 round(three.accuracy - four.accuracy, 6) AS accuracy_gain,
 round((three.accuracy - four.accuracy) * 100 / four.accuracy, 6) AS accuracy_gain_pct,
 round(three.macro_f1 - four.macro_f1, 6) AS macro_f1_gain,
 round((three.macro_f1 - four.macro_f1) * 100 / four.macro_f1, 6) AS macro_f1_gain_pct
FROM four JOIN three USING (system)""")
def merged_gain(spark, sf):
    out = ops.merged_comparison(ops.confusion_cells(matched(spark, sf), ["system"]), ["system"])
    return rounded(out, [c for c in out.columns if c not in ("system", "n_samples")])


@query("mode_comparison", f"""WITH {PAIRS}, {metric_sql('pairs', 'judge, mode', VOTE_LABELS)},
 m AS (SELECT judge, avg(accuracy) FILTER (mode='with_execution') AS a, avg(accuracy) FILTER (mode='without_execution') AS b
  FROM (SELECT judge, mode, accuracy FROM scores UNION ALL SELECT 'ALL', mode, accuracy FROM scores) GROUP BY judge)
SELECT judge, round(a, 6) AS with_execution, round(b, 6) AS without_execution, round(a - b, 6) AS difference,
 round((a - b) * 100 / b, 6) AS difference_pct FROM m""")
def mode_comparison(spark, sf):
    scores = ops.metrics(ops.confusion_cells(matched(spark, sf), ["judge", "mode"]), ["judge", "mode"])
    both = scores.withColumn("judge", F.explode(F.array("judge", F.lit("ALL"))))
    out = ops.mode_comparison(both, ["judge"])
    return rounded(out, [c for c in out.columns if c != "judge"])


@query("merged_summary", f"""WITH {PAIRS}, {MERGED}, {metric_sql('merged', 'system', MERGED_LABELS)}
SELECT system, n_samples, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
 row_number() OVER (ORDER BY accuracy DESC, system) AS accuracy_rank,
 row_number() OVER (ORDER BY macro_f1 DESC, system) AS macro_f1_rank FROM scores""")
def merged_summary(spark, sf):
    cells = ops.merged_cells(ops.confusion_cells(matched(spark, sf), ["system"]))
    return rounded(ops.merged_summary(ops.metrics(cells, ["system"], MERGED_LABELS)), ["accuracy", "macro_f1"])


RANKED = ["accuracy", "macro_f1", "cohen_kappa", "matthews_corrcoef"]


@query("metric_rankings", f"""WITH {PAIRS}, {metric_sql('pairs', 'system', VOTE_LABELS)},
 long AS ({' UNION ALL '.join(f"SELECT system, n_samples, '{m}' AS metric, round({m}, 6) AS score FROM scores" for m in RANKED)})
SELECT *, row_number() OVER (PARTITION BY metric ORDER BY score DESC, system) AS rank FROM long""")
def metric_rankings(spark, sf):
    scores = rounded(ops.metrics(ops.confusion_cells(matched(spark, sf), ["system"]), ["system"]), NUMBERS)
    return ops.metric_rankings(scores, "system", RANKED)


@query("best_system", f"""WITH {PAIRS}, {metric_sql('pairs', 'system', VOTE_LABELS)}
SELECT {', '.join(f'arg_max(system, {m}) AS best_{m}' for m in RANKED)} FROM scores""")
def best_system(spark, sf):
    scores = ops.metrics(ops.confusion_cells(matched(spark, sf), ["system"]), ["system"])
    return ops.best_system(scores, "system", RANKED)


BINARY = """pairs AS (SELECT d.lang AS system, CAST(l.quality AS VARCHAR) AS truth, CAST(1 - l.toxic AS VARCHAR) AS guess
 FROM labels l JOIN documents d USING (doc_id))"""


@query("binary_label_agreement", f"""WITH {BINARY}, {metric_sql('pairs', 'system', ['0', '1'])}
SELECT system, n_samples, {ROUNDED} FROM scores""")
def binary_label_agreement(spark, sf):
    labels, docs = view(spark, sf, "labels"), view(spark, sf, "documents").select("doc_id", "lang")
    pairs = labels.join(docs, "doc_id").select(
        F.col("lang").alias("system"),
        F.col("quality").cast("string").alias("truth"),
        (1 - F.col("toxic")).cast("string").alias("guess"),
    )
    cells = ops.confusion_cells(pairs, ["system"], "truth", "guess")
    return rounded(ops.metrics(cells, ["system"], ["0", "1"]), NUMBERS)
