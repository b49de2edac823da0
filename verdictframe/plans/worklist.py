"""Judge tasks, resume worklists, pair assignment and seed samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import draws
from verdictframe.operators import battles, worklist
from verdictframe.plans.ratings import mix_sql
from verdictframe.plans.registry import query
from verdictframe.sources.views import view

ANSWERED = """ans AS (SELECT uid, model, any_value(answer) AS answer FROM (SELECT seq % (SELECT count(*) FROM questions) AS uid, model_a AS model,
   'answer of ' || model_a AS answer FROM battles) GROUP BY ALL),
 done AS (SELECT DISTINCT uid, model FROM ans WHERE model >= 'm09')"""


def answered(spark, sf):
    n = view(spark, sf, "questions").count()
    rows = view(spark, sf, "battles").select(
        (F.col("seq") % n).alias("uid"), F.col("model_a").alias("model"), "seq",
        F.concat(F.lit("answer of "), "model_a").alias("answer"),
    )
    return battles.latest(rows, ["uid", "model"], "seq").drop("seq")


@query("judge_tasks", f"""WITH {ANSWERED}, o AS (SELECT a.uid, a.model, a.answer, b.answer AS ba FROM ans a JOIN ans b ON a.uid = b.uid AND b.model = 'm03'
 JOIN questions q ON q.uid = a.uid WHERE a.model <> 'm03' AND (a.uid, a.model) NOT IN (SELECT (uid, model) FROM done))
SELECT uid, model, 'm03' AS baseline, 'jA' AS judge, 1 AS round, ba AS answer_a, answer AS answer_b FROM o
UNION ALL SELECT uid, model, 'm03', 'jA', 2, answer, ba FROM o""")
def judge_tasks(spark, sf):
    answers = answered(spark, sf)
    done = answers.filter("model >= 'm09'")
    out = worklist.judge_tasks(view(spark, sf, "questions"), answers, done, "m03", "jA")
    return out.drop("instruction")


STATUS = """status AS (SELECT uid, CASE WHEN trim(stderr) <> '' THEN 'failed' ELSE 'completed' END AS state FROM executions WHERE environment <> 'Vue')"""


def status(spark, sf):
    """All environments but one have run already, some of them in vain."""
    return view(spark, sf, "executions").filter("environment <> 'Vue'").select(
        "uid", F.when(F.trim("stderr") != "", "failed").otherwise("completed").alias("state")
    )


@query("open_records", f"WITH {STATUS} SELECT uid FROM executions WHERE uid NOT IN (SELECT uid FROM status)")
def open_records(spark, sf):
    return worklist.open_records(view(spark, sf, "executions"), status(spark, sf), "uid").select("uid")


@query("open_records_with_retry", f"WITH {STATUS} SELECT uid FROM executions WHERE uid NOT IN (SELECT uid FROM status WHERE state = 'completed')")
def open_records_with_retry(spark, sf):
    return worklist.open_records(view(spark, sf, "executions"), status(spark, sf), "uid", True).select("uid")


@query("progress", f"""WITH {STATUS}, c AS (SELECT count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'failed') AS failed FROM status),
 o AS (SELECT count(*) AS n FROM executions WHERE uid NOT IN (SELECT uid FROM status))
SELECT n + completed + failed AS total, completed, failed, n AS remaining, round(completed / (n + completed + failed), 6) AS completion_rate FROM c, o""")
def progress(spark, sf):
    out = worklist.progress(status(spark, sf), open_records(spark, sf))
    return out.withColumn("completion_rate", F.round("completion_rate", 6))


@query("executions_with_generations", """SELECT e.uid, e.model, q.category FROM executions e LEFT JOIN questions q ON q.uid = e.uid""")
def executions_with_generations(spark, sf):
    """Executions keep their row when the generation is missing."""
    generations = view(spark, sf, "questions").select("uid", "category")
    return view(spark, sf, "executions").select("uid", "model").join(generations, "uid", "left")


@query("filtered_executions", """SELECT uid, environment, category FROM executions WHERE environment IN ('React', 'Vue') AND category IN ('cat1', 'cat2') AND environment <> ''""")
def filtered_executions(spark, sf):
    rows = view(spark, sf, "executions").filter(
        F.col("environment").isin("React", "Vue") & F.col("category").isin("cat1", "cat2")
    )
    return rows.select("uid", "environment", "category")


@query("answers_by_model", """SELECT uid, array_to_string(list_sort(list(model || '=' || environment)), ',') AS answers FROM (
 SELECT uid // 20 AS uid, model, arg_max(environment, uid) AS environment FROM executions GROUP BY ALL) GROUP BY uid""")
def answers_by_model(spark, sf):
    """One map per question from model to its latest row."""
    from verdictframe.sources.jsonl import by_model

    rows = view(spark, sf, "executions").select(
        F.floor(F.col("uid") / 20).alias("uid"), "model", "environment", F.col("uid").alias("seq")
    )
    latest = battles.latest(rows, ["uid", "model"], "seq").drop("seq")
    entries = F.transform(F.map_entries("models"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["environment"]))
    return by_model(latest).select("uid", F.array_join(F.array_sort(entries), ",").alias("answers"))


RULES = """models AS (SELECT model_a AS model, count(*)::DOUBLE AS weight, model_a = 'm02' AS outage, model_a = 'm04' AS boost, model_a IN ('m05', 'm06') AS anonymous,
  CASE WHEN model_a = 'm07' THEN ['m1', 'm08'] ELSE [] END AS strict, CASE WHEN model_a = 'm01' THEN ['m03', 'm09'] ELSE [] END AS targets FROM battles GROUP BY model_a),
 w AS (SELECT *, CASE WHEN outage THEN 0 ELSE weight END AS rival_w, CASE WHEN outage THEN 0 ELSE weight END * CASE WHEN boost THEN 2 ELSE 1 END AS first_w FROM models),
 f AS (SELECT model, sum(first_w) OVER (ORDER BY model ROWS UNBOUNDED PRECEDING) / sum(first_w) OVER () AS hi, row_number() OVER (ORDER BY model DESC) AS back FROM w),
 fi AS (SELECT model, coalesce(lag(hi) OVER (ORDER BY model), 0) AS lo, CASE WHEN back = 1 THEN 2 ELSE hi END AS hi FROM f),
 r AS (SELECT a.model, b.model AS rival, CASE WHEN list_contains(a.targets, b.model) AND b.rival_w <> 0 THEN 0.5 * (SELECT sum(first_w) FROM w) / len(a.targets) ELSE b.rival_w END AS rw
  FROM w a JOIN w b ON a.model <> b.model WHERE NOT (a.anonymous AND b.anonymous)
  AND (len(a.strict) = 0 OR len(list_filter(a.strict, lambda p: contains(b.model, p))) > 0)
  AND (len(b.strict) = 0 OR len(list_filter(b.strict, lambda p: contains(a.model, p))) > 0)),
 rh AS (SELECT *, sum(rw) OVER (PARTITION BY model ORDER BY rival ROWS UNBOUNDED PRECEDING) / sum(rw) OVER (PARTITION BY model) AS hi,
  row_number() OVER (PARTITION BY model ORDER BY rival DESC) AS back FROM r),
 ri AS (SELECT model, rival, coalesce(lag(hi) OVER (PARTITION BY model ORDER BY rival), 0) AS lo, CASE WHEN back = 1 THEN 2 ELSE hi END AS hi FROM rh),
 u AS (SELECT conv_id, ('0x' || substr(md5('17:first:' || conv_id), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u1,
  ('0x' || substr(md5('17:rival:' || conv_id), 1, 15))::BIGINT / 1152921504606846976.0::DOUBLE AS u2,
  ('0x' || substr(md5('17:swap:' || conv_id), 1, 15))::BIGINT % 2 AS swap FROM conversations WHERE turn = 0)"""


@query("battle_pair_assignment", f"""WITH {RULES} SELECT conv_id, CASE WHEN swap = 0 THEN fi.model ELSE rival END AS model_a, CASE WHEN swap = 0 THEN rival ELSE fi.model END AS model_b
FROM u JOIN fi ON fi.lo <= u1 AND u1 < fi.hi JOIN ri ON ri.model = fi.model AND ri.lo <= u2 AND u2 < ri.hi""")
def battle_pair_assignment(spark, sf):
    m = F.col("model_a")
    none = F.array().cast("array<string>")
    models = view(spark, sf, "battles").groupBy(m.alias("model")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    m = F.col("model")
    models = models.select(
        "model", "weight", (m == "m02").alias("outage"), (m == "m04").alias("boost"), m.isin("m05", "m06").alias("anonymous"),
        F.when(m == "m07", F.array(F.lit("m1"), F.lit("m08"))).otherwise(none).alias("strict"),
        F.when(m == "m01", F.array(F.lit("m03"), F.lit("m09"))).otherwise(none).alias("targets"),
    )
    prompts = view(spark, sf, "conversations").filter("turn = 0").select("conv_id")
    return worklist.battle_pairs(prompts, models, "conv_id")


TURNED = mix_sql(f"(key + r + i * {draws.MULTIPLIER}) & {draws.WORD}")
SAMPLED = f"""s AS (SELECT category, uid, instruction, row_number() OVER (PARTITION BY category ORDER BY uid) - 1 AS position, count(*) OVER (PARTITION BY category) AS n FROM questions),
 r AS (SELECT 'cat' || doc_id % 6 AS category, doc_id AS request FROM documents),
 z AS (SELECT category, n, ceil(sqrt(n))::BIGINT AS a FROM s GROUP BY ALL),
 turn(category, request, slot, n, a, key, i, l, r) AS (
  SELECT category, request, slot, n, a, ('0x' || substr(md5('17:' || category || ':' || request), 1, 15))::BIGINT, 1, slot // a, slot % a
   FROM r JOIN z USING (category), (SELECT unnest([0, 1])::BIGINT AS slot) WHERE slot < n
  UNION ALL
  SELECT category, request, slot, n, a, key, CASE WHEN i = {draws.FEISTEL_ROUNDS} AND r * a + f >= n THEN 1 ELSE i + 1 END, r, f
   FROM (SELECT *, (l + {TURNED}) % a AS f FROM turn WHERE i <= {draws.FEISTEL_ROUNDS})),
 t AS (SELECT category, request, slot, l * a + r AS position FROM turn WHERE i = {draws.FEISTEL_ROUNDS} + 1)"""


def sampled(spark, sf):
    requests = view(spark, sf, "documents").select(
        F.concat(F.lit("cat"), (F.col("doc_id") % 6).cast("string")).alias("category"), F.col("doc_id").alias("request")
    )
    seeds = view(spark, sf, "questions").select("category", F.col("uid").alias("seed_no"), "uid", "instruction")
    return worklist.seed_samples(requests, seeds, 2)


@query("seed_samples", f"WITH {SAMPLED} SELECT t.category, request, slot, s.uid AS seed_uid FROM t JOIN s ON s.category = t.category AND s.position = t.position")
def seed_samples(spark, sf):
    return sampled(spark, sf).select("category", "request", "slot", "seed_uid")


@query("seed_prompts", f"""WITH {SAMPLED} SELECT t.category, request, 'Like these:' || chr(10) || string_agg('[Question ' || (slot + 1) || ']: ' || instruction || chr(10) || chr(10), '' ORDER BY slot) || 'Go.' AS prompt,
 string_agg(s.uid::VARCHAR, ',' ORDER BY slot) AS seeds FROM t JOIN s ON s.category = t.category AND s.position = t.position GROUP BY ALL""")
def seed_prompts(spark, sf):
    out = worklist.seed_prompts(sampled(spark, sf), "Like these:\n{SAMPLE_QUESTIONS}Go.")
    return out.select("category", "request", "prompt", F.array_join("source_seeds", ",").alias("seeds"))
