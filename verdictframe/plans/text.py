"""Verdicts, assessments, clean-up, prompts, nested records and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import cleanup, prompts, records, verdicts
from verdictframe.functions.predicates import squeeze
from verdictframe.operators import battles, quality
from verdictframe.plans.code import q, stripped
from verdictframe.plans.registry import query
from verdictframe.session import truncate
from verdictframe.sources.views import view

NL = "chr(10)"


# ------------------------------------------------------------------- verdicts

@query("verdict_labels", f"""SELECT uid, coalesce(
 list_extract(regexp_extract_all(upper(judgment), {q(verdicts.VERDICT_PATTERNS[0])}, 1), -1),
 list_extract(regexp_extract_all(upper(judgment), {q(verdicts.VERDICT_PATTERNS[1])}, 1), -1)) AS score FROM verdict_texts""")
def verdict_labels(spark, sf):
    rows = view(spark, sf, "verdict_texts")
    return rows.select("uid", verdicts.verdict_label(F.col("judgment")).alias("score"))


REPLY_VOTES = """CASE seq % 16 WHEN 0 THEN 'vote_left' WHEN 1 THEN 'vote_right' WHEN 2 THEN 'vote_tie' WHEN 3 THEN 'vote_both_bad'
 WHEN 4 THEN 'vote_right' WHEN 5 THEN 'vote_left' WHEN 6 THEN 'vote_left' {extra} ELSE 'error' END"""
KEYWORDS = "WHEN 8 THEN 'vote_right' WHEN 9 THEN 'vote_left' WHEN 10 THEN 'vote_tie' WHEN 11 THEN 'vote_both_bad'"


@query("judgment_json_votes", f"SELECT seq AS uid, {REPLY_VOTES.format(extra='')} AS vote FROM battles")
def judgment_json_votes(spark, sf):
    rows = quality.parsed_replies(view(spark, sf, "judge_replies"), "reply")
    return rows.select("uid", verdicts.overall_vote(F.col("json")).alias("vote"))


@query("reply_votes", f"""SELECT seq AS uid, {REPLY_VOTES.format(extra=KEYWORDS)} AS vote,
 {REPLY_VOTES.format(extra=KEYWORDS + " WHEN 14 THEN 'vote_left'")} AS simple_vote FROM battles""")
def reply_votes(spark, sf):
    rows = quality.voted_replies(view(spark, sf, "judge_replies"), "reply")
    simple = F.coalesce(verdicts.short_vote(F.col("reply")), "vote")
    return rows.select("uid", "vote", simple.alias("simple_vote"))


@query("keyword_votes", """SELECT uid, CASE WHEN contains(lower(judgment), 'vote_left') THEN 'vote_left' WHEN contains(lower(judgment), 'neither') THEN 'vote_both_bad'
 ELSE 'error' END AS vote FROM verdict_texts""")
def keyword_votes(spark, sf):
    rows = view(spark, sf, "verdict_texts")
    return rows.select("uid", verdicts.keyword_vote(F.col("judgment")).alias("vote"))


EVALUATED = """e AS (SELECT uid, category, uid % 6 AS c FROM evaluations),
 f AS (SELECT uid, category, CASE c WHEN 0 THEN 'PASS' WHEN 1 THEN 'PARTIAL' WHEN 5 THEN 'UNSURE' ELSE 'FAIL' END AS verdict,
  CASE c WHEN 3 THEN 'error' WHEN 4 THEN 'error' WHEN 5 THEN 'late' ELSE 'success' END AS status,
  (CASE c WHEN 0 THEN 60 + uid % 40 WHEN 1 THEN uid % 60 WHEN 2 THEN 12 ELSE 0 END)::DOUBLE AS score FROM e)"""


@query("parsed_evaluations", f"WITH {EVALUATED} SELECT uid, status, verdict, score FROM f")
def parsed_evaluations(spark, sf):
    rows = view(spark, sf, "evaluations")
    return rows.select("uid", verdicts.evaluation(F.col("response")).alias("e")).select("uid", "e.*")


@query("verdict_summary", f"""WITH {EVALUATED} SELECT category, count(*) AS total, count(*) FILTER (verdict = 'PASS') AS passed,
 count(*) FILTER (verdict = 'PARTIAL') AS partial, count(*) FILTER (verdict NOT IN ('PASS', 'PARTIAL')) AS failed,
 round(avg(score), 6) AS mean_score FROM f GROUP BY category""")
def verdict_summary(spark, sf):
    out = quality.verdict_summary(view(spark, sf, "evaluations"), ["category"])
    return out.withColumn("mean_score", F.round("mean_score", 6))


def tag(part: str, name: str) -> str:
    return f"nullif(trim(regexp_extract({part}, '(?s)<{name}>(.*?)</{name}>', 1)), '')"


ASSESSED = f"""b AS (SELECT uid, category, instruction, response, regexp_extract(response, '(?s)<response>.*</response>', 0) AS body FROM assessments),
 p AS (SELECT *, regexp_extract(body, '(?s)<question_quality>(.*?)</question_quality>', 1) AS qq,
  regexp_extract(body, '(?s)<question_difficulty>(.*?)</question_difficulty>', 1) AS qd FROM b),
 a AS (SELECT *, {tag('qq', 'rating')} AS quality, {tag('qq', 'reasoning')} AS reasoning, {tag('qd', 'rating')} AS difficulty FROM p
  WHERE {tag('qq', 'rating')} IS NOT NULL OR {tag('qd', 'rating')} IS NOT NULL)"""


def assessed(spark, sf):
    rows = view(spark, sf, "assessments").withColumn("assessment", verdicts.assessment(F.col("response")))
    return rows.filter(F.col("assessment").isNotNull())


@query("parsed_assessments", f"""WITH {ASSESSED} SELECT uid, quality, reasoning, difficulty, left(instruction, 100) || '...' AS instruction,
 CASE WHEN length(response) > 500 THEN left(response, 500) || '...' ELSE response END AS raw FROM a""")
def parsed_assessments(spark, sf):
    return assessed(spark, sf).select(
        "uid", F.col("assessment.question_quality.rating").alias("quality"),
        F.col("assessment.question_quality.reasoning").alias("reasoning"),
        F.col("assessment.question_difficulty.rating").alias("difficulty"),
        verdicts.preview(F.col("instruction"), 100, always=True).alias("instruction"),
        verdicts.preview(F.col("response"), 500).alias("raw"),
    )


LEVELS = ", ".join(q(r) for r in verdicts.RATING_LEVELS)


@query("rating_distribution", f"""WITH {ASSESSED}, l AS (SELECT 'question_quality' AS dimension, quality AS rating FROM a
 UNION ALL SELECT 'question_difficulty', difficulty FROM a)
SELECT dimension, rating, count(*) AS n, list_position([{LEVELS}], rating)::BIGINT AS level FROM l WHERE rating IS NOT NULL GROUP BY ALL""")
def rating_distribution(spark, sf):
    return quality.rating_distribution(assessed(spark, sf))


@query("questionable_questions", f"WITH {ASSESSED} SELECT uid, category, 'question_quality' AS issues FROM a WHERE quality IN ('poor', 'very poor')")
def questionable_questions(spark, sf):
    return quality.questionable(assessed(spark, sf)).select("uid", "category", "issues")


@query("answers_after_thinking", f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE
 {stripped("source || ' </think> ' || text")} END AS answer FROM documents""")
def answers_after_thinking(spark, sf):
    docs = view(spark, sf, "documents")
    thought = F.concat(F.lit("<think> why </think>"), F.col("source"), F.lit(" </think> "), F.col("text"))
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(thought)
    return docs.select("doc_id", verdicts.answer_after_thinking(text).alias("answer"))


# ------------------------------------------------------------------- clean-up

def artefact_chain(column: str) -> str:
    out = stripped(column)
    for pattern in cleanup.LINE_ARTEFACTS:
        out = f"regexp_replace({out}, {q('(?im)' + pattern)}, '', 'g')"
    out = f"regexp_replace({out}, {q(cleanup.QUESTION_NUMBER)}, '')"
    out = f"regexp_replace({out}, {q(cleanup.HEADING_MARK)}, '')"
    return stripped(f"regexp_replace({out}, {q(cleanup.BLANK_LINES)}, {NL}, 'g')")


@query("clean_questions", f"""WITH c AS (SELECT uid, category, {artefact_chain('raw')} AS instruction FROM generated_texts),
 k AS (SELECT * FROM c WHERE instruction <> '')
SELECT category, 'gen_' || lpad((row_number() OVER (PARTITION BY category ORDER BY uid) - 1)::VARCHAR, 6, '0') AS uid, instruction FROM k""")
def clean_questions(spark, sf):
    """Cleaned and numbered per category; empty ones drop out first."""
    from verdictframe.functions.draws import dense_index

    rows = view(spark, sf, "generated_texts").select(
        "uid", "category", cleanup.clean_question(F.col("raw")).alias("instruction")
    ).filter("instruction <> ''")
    # Numbering reads its input more than once: clean the texts only once.
    numbered = dense_index(truncate(rows), ["category"], "uid", "n")
    return numbered.select("category", F.format_string("gen_%06d", "n").alias("uid"), "instruction")


def has_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


@query("clean_solutions", f"""WITH l AS (SELECT uid, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT uid, string_split(solution_text, {NL}) AS s FROM solutions)),
 m AS (SELECT uid, s, i, lower({stripped('s[i]')}) AS t FROM l),
 f AS (SELECT uid, min(i) AS first FROM m WHERE NOT {has_any('t', cleanup.META_PHRASES)} AND {has_any('t', cleanup.CODE_MARKS)} GROUP BY uid),
 k AS (SELECT x.uid, coalesce(array_to_string(x.s[f.first:], {NL}), '') AS body FROM (SELECT DISTINCT uid, s FROM l) x LEFT JOIN f USING (uid)),
 b AS (SELECT uid, {stripped("regexp_replace(" + stripped('body') + ", '^(?:```[^" + chr(92) + "n]*" + chr(92) + "n" + chr(92) + "s*)+', '')")} AS body FROM k)
SELECT uid, regexp_replace(body, '(?:\\s*```)+$', '') AS solution FROM b""")
def clean_solutions(spark, sf):
    rows = view(spark, sf, "solutions")
    return rows.select("uid", cleanup.clean_solution(F.col("solution_text")).alias("solution"))


@query("solution_coverage", """SELECT count(*) AS total, (SELECT count(*) FROM documents WHERE doc_id % 4 IN (0, 1)) AS with_tests FROM documents""")
def solution_coverage(spark, sf):
    rows = view(spark, sf, "solutions").select(
        cleanup.clean_solution(F.col("solution_text")).alias("solution"),
        cleanup.test_cases(F.col("test_text")).alias("test_cases"),
    )
    return quality.coverage(rows).select("total", "with_tests")


@query("parsed_test_cases", """SELECT doc_id AS uid, unnest([doc_id::VARCHAR, 'a']) AS input, unnest(['1', '[2]']) AS expected_output FROM documents WHERE doc_id % 4 = 0""")
def parsed_test_cases(spark, sf):
    rows = view(spark, sf, "solutions").select("uid", cleanup.test_cases(F.col("test_text")).alias("t"))
    cases = F.explode(F.try_variant_get("t", "$", "array<struct<input variant, expected_output variant>>"))
    rows = rows.select("uid", cases.alias("c"))
    return rows.select(
        "uid", F.try_variant_get("c.input", "$", "string").alias("input"),
        F.try_variant_get("c.expected_output", "$", "string").alias("expected_output"),
    )


MARKERS = {0: cleanup.ENRICHMENT_MARKERS[0], 1: cleanup.ENRICHMENT_MARKERS[1], 2: cleanup.ENRICHMENT_MARKERS[3]}


def enriched_text():
    marker = F.lit(None).cast("string")
    for k, text in MARKERS.items():
        marker = F.when(F.col("doc_id") % 4 == k, F.lit(text)).otherwise(marker)
    return F.when(marker.isNull(), F.col("text")).otherwise(
        F.concat(F.col("text"), F.lit("\n\n"), marker, F.lit("\n"), F.col("text"))
    )


@query("enrichment_stripped", f"SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN text ELSE {stripped('text')} END AS question FROM documents")
def enrichment_stripped(spark, sf):
    docs = view(spark, sf, "documents").withColumn("enriched", enriched_text())
    return docs.select("doc_id", cleanup.without_enrichment(F.col("enriched")).alias("question"))


RULE = "repeat('=', 80)"


@query("truncated_prompts", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || ' task ' || {NL} || {RULE} || text || {RULE} ELSE text END AS x FROM documents)
SELECT doc_id, CASE WHEN length(x) <= 1500 THEN x WHEN contains(x, {RULE}) THEN string_split(x, {RULE})[1] || {NL} || {NL} || left(string_split(x, {RULE})[2], 800)
 ELSE left(x, 1500) END AS prompt FROM t""")
def truncated_prompts(spark, sf):
    docs = view(spark, sf, "documents")
    rule = F.lit(cleanup.RULE)
    text = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.col("source"), F.lit(" task \n"), rule, F.col("text"), rule),
    ).otherwise(F.col("text"))
    return docs.select("doc_id", cleanup.truncated_prompt(text).alias("prompt"))


@query("example_links", f"""WITH x AS (SELECT uid, list_concat(
   list_slice(regexp_extract_all(readme, {q(cleanup.EXAMPLE_LINK_PATTERNS[0])}, 1), 1, 2),
   list_slice(regexp_extract_all(readme, {q(cleanup.EXAMPLE_LINK_PATTERNS[1])}, 1), 1, 2),
   ['https://github.com/' || repo || '/tree/main/examples', 'https://github.com/' || repo || '/tree/main/demo', 'https://github.com/' || repo || '/tree/main/samples'])[1:3] AS l FROM readmes)
SELECT uid, unnest(range(0, len(l))) AS position, unnest(l) AS url FROM x""")
def example_links(spark, sf):
    links = cleanup.example_links(F.col("readme"), F.col("repo"))
    rows = view(spark, sf, "readmes").select("uid", F.posexplode(links).alias("position", "url"))
    return rows.withColumn("position", F.col("position").cast("bigint"))


# ---------------------------------------------------------------------- quality

QUALITY = f"""s AS (SELECT *, (contains(answer, 'def ') OR contains(answer, 'class ')) AS unit, contains(answer, 'import ') AS imp,
  (contains(answer, '```') OR contains(answer, '    ')) AS block,
  length(replace(answer, '(', '')) = length(replace(answer, ')', '')) AND length(replace(answer, '[', '')) = length(replace(answer, ']', ''))
   AND length(replace(answer, '{{', '')) = length(replace(answer, '}}', '')) AS bal,
  (contains(answer, '\"\"\"') OR contains(answer, '''''''') OR contains(answer, '#')) AS doc FROM answers),
 v AS (SELECT *, CASE WHEN answer = '' OR starts_with(answer, 'ERROR') THEN 0 WHEN NOT (unit OR imp OR block) THEN 0.1 ELSE
  0.2::DOUBLE + least(CASE WHEN unit THEN 0.3 ELSE 0 END + CASE WHEN imp THEN 0.2 ELSE 0 END + CASE WHEN block THEN 0.2 ELSE 0 END, 0.3)::DOUBLE
   + (CASE WHEN bal THEN 0.2 ELSE 0.05 END)::DOUBLE + (CASE WHEN doc THEN 0.15 ELSE 0.05 END)::DOUBLE + 0.1::DOUBLE END::DOUBLE AS score FROM s),
 g AS (SELECT uid, category, answer, score, score > 0.59 AS passed, starts_with(answer, 'ERROR') AS failed_run, bal, doc, (unit OR imp OR block) AS structured FROM v)"""


@query("answer_quality", f"""WITH {QUALITY} SELECT uid, passed, round(score, 6) AS score,
 CASE WHEN failed_run THEN 'Execution error' WHEN NOT structured THEN 'No valid code structure' WHEN passed THEN 'Passed' ELSE 'Below threshold' END AS reason,
 CASE WHEN failed_run THEN 'Execution error' WHEN NOT structured THEN 'No valid code structure' WHEN bal AND doc THEN 'All checks passed'
  ELSE concat_ws('; ', CASE WHEN NOT bal THEN 'Unbalanced brackets/parentheses/braces' END, CASE WHEN NOT doc THEN 'No documentation/comments' END) END AS issues
FROM g""")
def answer_quality(spark, sf):
    graded = quality.graded_answers(view(spark, sf, "answers"))
    return graded.select("uid", "passed", F.round("score", 6).alias("score"), "reason", "issues")


@query("quality_summary", f"""WITH {QUALITY}, r AS (SELECT category, count(*) AS total, count(*) FILTER (passed) AS passed,
  count(*) FILTER (NOT passed AND NOT failed_run) AS failed, count(*) FILTER (failed_run) AS errors, avg(score) AS m FROM g GROUP BY ROLLUP (category))
SELECT coalesce(category, 'TOTAL') AS category, total, passed, failed, errors, round(passed / total * 100, 6) AS pass_rate, round(m, 6) AS mean_score FROM r""")
def quality_summary(spark, sf):
    out = quality.quality_summary(quality.graded_answers(view(spark, sf, "answers")))
    return out.withColumn("pass_rate", F.round("pass_rate", 6)).withColumn("mean_score", F.round("mean_score", 6))


@query("example_answers", f"""WITH {QUALITY}, c AS (SELECT uid, CASE WHEN failed_run THEN 'error' WHEN passed THEN 'passed' ELSE 'failed' END AS class FROM g),
 n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY uid) AS position FROM c)
SELECT class, uid, position FROM n WHERE position <= CASE WHEN class = 'error' THEN 1 ELSE 2 END""")
def example_answers(spark, sf):
    out = quality.example_answers(quality.graded_answers(view(spark, sf, "answers")))
    return out.select("class", "uid", F.col("position").cast("bigint").alias("position"))


# -------------------------------------------------------------------- execution

EXEC = f"""x AS (SELECT model, environment, category, trim(stderr) = '' AS ok, stderr FROM executions),
 lv AS (SELECT model, 'overall' AS level, '' AS value, ok, stderr FROM x UNION ALL SELECT model, 'environment', environment, ok, stderr FROM x
  UNION ALL SELECT model, 'category', category, ok, stderr FROM x)"""


@query("execution_summary", f"""WITH {EXEC} SELECT level, value, count(*) AS total, count(*) FILTER (ok) AS success,
 count(*) FILTER (stderr = 'No code to execute') AS no_code, 0::BIGINT AS missing_fields, count(*) FILTER (NOT ok) AS failed,
 round(count(*) FILTER (ok) / count(*) * 100, 6) AS success_rate FROM lv GROUP BY level, value""")
def execution_summary(spark, sf):
    out = quality.execution_summary(view(spark, sf, "executions"))
    return out.withColumn("success_rate", F.round("success_rate", 6))


@query("execution_summary_by_model", f"""WITH {EXEC} SELECT model, level, value, count(*) AS total, count(*) FILTER (ok) AS success,
 round(count(*) FILTER (ok) / count(*) * 100, 6) AS success_rate FROM lv GROUP BY ALL""")
def execution_summary_by_model(spark, sf):
    out = quality.execution_summary(view(spark, sf, "executions"), ["model"])
    return out.select("model", "level", "value", "total", "success", F.round("success_rate", 6).alias("success_rate"))


def lopsided(spark, sf):
    """Two models, of which one never ran one of the environments."""
    rows = view(spark, sf, "executions").filter("NOT (model = 'm03' AND environment = 'Vue')")
    return quality.execution_summary(rows, ["model"])


LOPSIDED = EXEC.replace("FROM executions)", "FROM executions WHERE NOT (model = 'm03' AND environment = 'Vue'))")


@query("compare_two_models", f"""WITH {LOPSIDED}, w AS (SELECT level, value,
 coalesce(count(*) FILTER (model = 'm03' AND ok) / nullif(count(*) FILTER (model = 'm03'), 0) * 100, 0) AS l,
 coalesce(count(*) FILTER (model = 'm07' AND ok) / nullif(count(*) FILTER (model = 'm07'), 0) * 100, 0) AS r,
 count(*) FILTER (model = 'm03') AS total_left, count(*) FILTER (model = 'm07') AS total_right FROM lv WHERE model IN ('m03', 'm07') GROUP BY ALL)
SELECT level, value, round(l, 6) AS rate_left, round(r, 6) AS rate_right, total_left, total_right, round(l - r, 6) AS difference,
 CASE WHEN l > r THEN 'm03' WHEN l < r THEN 'm07' ELSE 'equal' END AS winner FROM w""")
def compare_two_models(spark, sf):
    out = quality.compare_two(lopsided(spark, sf), "m03", "m07")
    return out.select(
        "level", "value", "total_left", "total_right", "winner",
        *[F.round(c, 6).alias(c) for c in ("rate_left", "rate_right", "difference")],
    )


MODELS = ["m01", "m03", "m07"]


@query("compare_many_models", f"""WITH {LOPSIDED} SELECT value AS environment,
 {', '.join(f"coalesce(round(count(*) FILTER (model = '{m}' AND ok) / nullif(count(*) FILTER (model = '{m}'), 0) * 100, 6), 0) AS {m}" for m in MODELS)}
FROM lv WHERE level = 'environment' GROUP BY value""")
def compare_many_models(spark, sf):
    out = quality.compare_many(lopsided(spark, sf), MODELS, "environment")
    return out.select(F.col("value").alias("environment"), *[F.round(m, 6).alias(m) for m in MODELS])


@query("strongest_environments", f"""WITH {EXEC}, r AS (SELECT model, value AS environment, round(count(*) FILTER (ok) / count(*) * 100, 6) AS success_rate
 FROM lv WHERE level = 'environment' GROUP BY ALL)
SELECT model, environment, success_rate, row_number() OVER (PARTITION BY model ORDER BY success_rate DESC, environment) AS position FROM r
QUALIFY position <= 3""")
def strongest_environments(spark, sf):
    summary = execution_summary_by_model(spark, sf)
    out = quality.strongest_environments(summary)
    return out.select("model", F.col("value").alias("environment"), "success_rate", F.col("position").cast("bigint").alias("position"))


# ---------------------------------------------------------------------- prompts

SIDE = """'<|The Start of Model Response|>' || chr(10) || {r} || chr(10) || '<|The End of Model Response|>'"""


@query("complete_answers", f"""WITH o AS (SELECT page_id, url, stdout, CASE WHEN page_id % 4 = 0 THEN '' ELSE stdout END AS so FROM pages JOIN outputs ON uid = page_id),
 e AS (SELECT page_id, CASE WHEN so <> '' THEN chr(10) || chr(10) || '<|The Start of Execution Results|>' || chr(10) ||
   CASE WHEN length(so) > 1000 THEN left(so, 1000) || chr(10) || '...[Truncated]' ELSE so END || chr(10) || '<|The End of Execution Results|>'
  WHEN page_id % 8 = 0 THEN '' ELSE chr(10) || chr(10) || '<|The Start of Execution Errors and Warnings|>' || chr(10) ||
   CASE WHEN length(stdout) > 1000 THEN left(stdout, 1000) || chr(10) || '...[Truncated]' ELSE stdout END || chr(10) || '<|The End of Execution Errors and Warnings|>' END AS t, url FROM o)
SELECT page_id AS uid, {SIDE.format(r='url')} || t AS answer FROM e""")
def complete_answers(spark, sf):
    rows = view(spark, sf, "outputs").join(
        view(spark, sf, "pages").select(F.col("page_id").alias("uid"), "url"), "uid"
    )
    stdout = F.when(F.col("uid") % 4 == 0, "").otherwise(F.col("stdout"))
    text = prompts.complete_answer(F.col("url"), stdout, F.col("stdout"), F.col("uid") % 8 == 0)
    return rows.select("uid", text.alias("answer"))


@query("reward_answers", """SELECT doc_id AS uid, CASE WHEN doc_id % 6 = 0 THEN '[No response found]' ELSE concat_ws(chr(10) || chr(10),
  '<|The Start of Code|>' || chr(10) || CASE WHEN length(text) > 20000 THEN left(text, 20000) || chr(10) || '...[Code truncated]' ELSE text END || chr(10) || '<|The End of Code|>',
  CASE WHEN doc_id % 2 = 0 THEN '<|The Start of Execution Results|>' || chr(10) || CASE WHEN length(text) > 3000 THEN left(text, 3000) || chr(10) || '...[Truncated]' ELSE text END
   || chr(10) || '<|The End of Execution Results|>' END) END AS answer FROM documents""")
def reward_answers(spark, sf):
    third = F.col("doc_id") % 6 == 0
    code = F.when(~third, F.col("text")).otherwise("")
    output = F.when(~third & (F.col("doc_id") % 2 == 0), F.col("text"))
    return view(spark, sf, "documents").select(
        F.col("doc_id").alias("uid"), prompts.reward_answer(code, output).alias("answer")
    )


SHOT = "chr(10) || '<|The Start of Assistant {s}''s UI Screenshot|>' || chr(10) || '{{SCREENSHOT_{s}}}' || chr(10) || '<|The End of Assistant {s}''s UI Screenshot|>'"


@query("judge_prompts", f"""SELECT uid, '<|The Start of User Question|>' || chr(10) || instruction || chr(10) || '<|The End of User Question|>' || chr(10) || chr(10)
 || '<|The Start of Assistant A''s Answer|>' || chr(10) || CASE WHEN uid % 5 = 0 THEN '[No code output]' ELSE category END
 || CASE WHEN uid % 2 = 0 THEN {SHOT.format(s='A')} ELSE '' END || '<|The End of Assistant A''s Answer|>' || chr(10) || chr(10)
 || '<|The Start of Assistant B''s Answer|>' || chr(10) || instruction || CASE WHEN uid % 3 = 0 THEN {SHOT.format(s='B')} ELSE '' END
 || '<|The End of Assistant B''s Answer|>' AS prompt FROM questions""")
def judge_prompts(spark, sf):
    a = F.when(F.col("uid") % 5 == 0, "").otherwise(F.col("category"))
    text = prompts.judge_prompt(
        F.col("instruction"), a, F.col("instruction"), F.col("uid") % 2 == 0, F.col("uid") % 3 == 0
    )
    return view(spark, sf, "questions").select("uid", text.alias("prompt"))


@query("evaluation_prompts", """SELECT page_id AS uid, 'Task: ' || left(html, 2000) || chr(10) || 'Code: ' || left(stdout, 2000) || chr(10) || 'Out: ' ||
 CASE WHEN page_id % 3 = 0 THEN '(no output)' ELSE left(stdout, 500) END || chr(10) || 'Err: (no errors)' AS prompt FROM pages JOIN outputs ON uid = page_id""")
def evaluation_prompts(spark, sf):
    rows = view(spark, sf, "outputs").join(view(spark, sf, "pages").select(F.col("page_id").alias("uid"), "html"), "uid")
    stdout = F.when(F.col("uid") % 3 == 0, "").otherwise(F.col("stdout"))
    text = prompts.evaluation_prompt(
        "Task: {QUESTION}\nCode: {CODE}\nOut: {STDOUT}\nErr: {STDERR}",
        F.col("html"), F.col("stdout"), stdout, F.lit(None).cast("string"),
    )
    return rows.select("uid", text.alias("prompt"))


# ---------------------------------------------------------------------- records

def reward_records(spark, sf):
    """Nested records: three rounds per side, some without any result."""
    e = view(spark, sf, "events")

    def round_of(key, output, shot):
        state = F.struct(output.alias("sandbox_output"), shot.alias("screenshot_base64"))
        return F.struct(F.lit(key).alias("key"), F.struct(state.alias("sandbox_state")).alias("value"))

    none = F.lit(None).cast("string")

    def side(shift):
        k = (F.col("event_id") + shift) % 4
        logs = F.map_from_entries(F.array(
            round_of("0", F.concat(F.lit("first "), "event_type"), F.lit("")),
            round_of("10", F.when(k != 3, F.concat(F.lit("tenth "), F.col("props"))), F.lit("")),
            round_of("9", F.when(k == 0, F.lit("ninth")), F.when(k == 1, F.lit("shot")).otherwise(none)),
        ))
        messages = F.array(F.array(F.lit("user"), F.lit("hi")), F.array(F.lit("assistant"), F.concat(F.lit("code "), F.col("props"))))
        return F.struct(messages.alias("messages"), logs.alias("sandbox_logs_by_round"))

    return e.select(
        F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).alias("chat_session_id"),
        "event_id", F.col("event_type").alias("instruction"),
        F.when(F.col("event_id") % 9 != 0, F.lit("mA")).alias("model_A"), F.lit("mB").alias("model_B"),
        F.struct(side(0).alias("model_A"), side(1).alias("model_B")).alias("states"),
    )


RUN = """CASE (event_id + {s}) % 4 WHEN 0 THEN 'ninth' WHEN 1 THEN '' WHEN 2 THEN 'tenth ' || props ELSE 'first ' || event_type END"""


@query("flattened_records", f"""SELECT CASE WHEN event_id % 5 <> 0 THEN event_id::VARCHAR END AS chat_session_id, event_type AS instruction,
 CASE WHEN event_id % 9 <> 0 THEN 'mA' ELSE 'unknown' END AS model_a, 'mB' AS model_b, 'code ' || props AS code_a, 'code ' || props AS code_b,
 {RUN.format(s=0)} AS output_a, {RUN.format(s=1)} AS output_b,
 CASE WHEN event_id % 4 = 1 THEN 'shot' ELSE '' END AS screenshot_a, CASE WHEN (event_id + 1) % 4 = 1 THEN 'shot' ELSE '' END AS screenshot_b FROM events""")
def flattened_records(spark, sf):
    return records.flatten_reward_record(reward_records(spark, sf))


@query("latest_outputs_numeric", """SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN 'tenth ' || props ELSE 'first ' || event_type END AS output FROM events""")
def latest_outputs_numeric(spark, sf):
    run = records.latest_execution(F.col("states.model_A.sandbox_logs_by_round"), numeric=True)
    return reward_records(spark, sf).select("event_id", run["output"].alias("output"))


@query("record_ids", """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN event_id::VARCHAR ELSE
 left(md5(event_type || '_' || CASE WHEN event_id % 9 <> 0 THEN 'mA' ELSE '' END || '_mB'), 16) END AS record_id FROM events""")
def record_ids(spark, sf):
    rows = reward_records(spark, sf)
    key = records.record_id(F.col("chat_session_id"), F.col("instruction"), F.col("model_A"), F.col("model_B"))
    return rows.select("event_id", key.alias("record_id"))


@query("embedded_visuals", " UNION ALL ".join(
    f"SELECT uid, '{kind}' AS type, unnest(regexp_extract_all(stdout, {q(pattern)}, {group})) AS data FROM outputs"
    for kind, pattern, group in records.VISUAL_PATTERNS))
def embedded_visuals(spark, sf):
    rows = view(spark, sf, "outputs").select("uid", F.explode(records.embedded_visuals(F.col("stdout"))).alias("v"))
    return rows.select("uid", "v.type", "v.data")


@query("conversation_summary", """SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS first_prompt,
 arg_max(text, turn) FILTER (role = 'assistant') AS last_answer, count(*) FILTER (role = 'user') AS user_messages FROM conversations GROUP BY conv_id""")
def conversation_summary(spark, sf):
    return records.conversation_summary(view(spark, sf, "conversations"))


@query("chat_messages", """WITH t AS (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN NULL ELSE text END AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, 'system:be brief' || coalesce(string_agg(chr(10) || CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), '' ORDER BY i)
 FILTER (i % 2 = 0 OR text IS NOT NULL), '') AS transcript FROM t GROUP BY conv_id""")
def chat_messages(spark, sf):
    turns = view(spark, sf, "conversations").withColumn(
        "text", F.when((F.col("conv_id") + F.col("turn")) % 7 != 0, F.col("text"))
    )
    chats = records.chat_messages(turns, "be brief")
    line = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit(""))))
    return chats.select("conv_id", F.array_join(line, "\n").alias("transcript"))


@query("answer_contents", "SELECT uid, answer FROM answers")
def answer_contents(spark, sf):
    """Union-typed contents: plain text, or JSON with the text in ``answer``."""
    content = F.when(
        F.col("uid") % 2 == 0, F.to_json(F.struct(F.col("answer").alias("answer")))
    ).otherwise(F.col("answer"))
    rows = view(spark, sf, "answers").select("uid", content.alias("content"))
    return rows.select("uid", records.answer_text(F.col("content")).alias("answer"))


@query("question_cases", """SELECT uid, category, environment, CASE WHEN stderr = '' THEN 'success' ELSE 'error' END AS kind FROM executions
QUALIFY row_number() OVER (PARTITION BY CASE WHEN stderr = '' THEN 'success' ELSE 'error' END ORDER BY uid) <= 5""")
def question_cases(spark, sf):
    """The first five successful and failed executions; any stderr is an error."""
    rows = view(spark, sf, "executions").withColumn(
        "kind", F.when(F.col("stderr") == "", "success").otherwise("error")
    )
    return battles.first_per_class(rows, ["kind"], [F.col("uid")], 5).select("uid", "category", "environment", "kind")


@query("normalised_topics", f"""SELECT uid, {stripped("'  ' || topic || chr(9)")} AS topic, string_split('org/team/' || model, '/')[-1] AS model FROM games""")
def normalised_topics(spark, sf):
    from verdictframe.functions.predicates import short_model_name

    topic = squeeze(F.concat(F.lit("  "), F.col("topic"), F.lit("\t")))
    return view(spark, sf, "games").select(
        "uid", topic.alias("topic"), short_model_name(F.concat(F.lit("org/team/"), F.col("model"))).alias("model")
    )
