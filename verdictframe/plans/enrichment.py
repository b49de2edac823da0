"""Keyword sets, resource and issue matching, enriched prompts, collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import keywords as kw
from verdictframe.operators import battles, enrichment, quality
from verdictframe.plans.code import q
from verdictframe.plans.registry import query
from verdictframe.plans.textratio import RATIO
from verdictframe.sources.views import view


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def any_of(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def language_sql(column: str) -> str:
    cases = " ".join(f"WHEN {any_of(column, w)} THEN {q(n)}" for n, w in kw.LANGUAGE_INDICATORS.items())
    return f"CASE {cases} WHEN {any_of(column, kw.BROWSER_WORDS)} THEN 'javascript' ELSE 'python' END"


SIGNED = f"""signed AS (SELECT uid, category, instruction,
  list_sort(list_intersect({sql_list(kw.TECHNICAL_KEYWORDS)}, regexp_extract_all(lower(instruction), '[{chr(92)}p{{L}}{chr(92)}p{{N}}_]+'))) AS kws,
  {language_sql('lower(instruction)')} AS lang FROM questions)"""


LANG_CASE = "CASE " + " ".join(f"WHEN {any_of('lower(repo)', w)} THEN {q(n)}" for n, w in kw.REPO_LANGUAGES.items()) + " ELSE 'general' END"
TASKS = f"""tasks AS (SELECT 'github-' || replace(repo, '/', '-') || '-' || number AS uid, left(title || chr(10) || chr(10) || body, 400) AS instruction, category, repo, number, label_pos, author,
  CASE WHEN {any_of('lower(labels)', kw.EASY_WORDS)} THEN 'easy' WHEN {any_of('lower(labels)', kw.HARD_WORDS)} THEN 'hard' ELSE 'medium' END AS difficulty,
  {LANG_CASE} AS language, 'GitHub - ' || repo AS source_name, 'https://github.com/' || repo || '/issues/' || number AS source
  FROM issues WHERE NOT is_pull_request AND body <> '')"""


def resources(spark, sf):
    rows = view(spark, sf, "resources")
    return rows.withColumn("tags", F.array("tag")).withColumn("topics", F.array("tag")).withColumn(
        "url", F.concat(F.lit("https://example.com/"), F.col("rid").cast("string"))
    )


@query("question_keywords", f"WITH {SIGNED} SELECT uid, array_to_string(kws, ',') AS keywords, lang AS language FROM signed")
def question_keywords(spark, sf):
    signed = enrichment.question_signatures(view(spark, sf, "questions"))
    return signed.select("uid", F.array_join("q_keywords", ",").alias("keywords"), F.col("q_language").alias("language"))


@query("document_keywords", f"""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_intersect({sql_list(kw.TECHNICAL_KEYWORDS)}, regexp_extract_all(t, '[{chr(92)}p{{L}}{chr(92)}p{{N}}_]+'))), ',') AS keywords,
 {language_sql('t')} AS language FROM d""")
def document_keywords(spark, sf):
    text = F.col("text")
    return view(spark, sf, "documents").select(
        "doc_id", F.array_join(kw.keywords(text), ",").alias("keywords"), kw.language_of(text).alias("language")
    )


SCORED = f"""{SIGNED}, scored AS (SELECT s.uid, s.category, r.rid, r.source,
  CASE r.source WHEN 'stackoverflow' THEN list_contains(s.kws, lower(r.tag))::INT / len(s.kws) * 40.0::DOUBLE + (least(r.votes / 5000.0::DOUBLE, 1) * 30 + least(r.answer_count / 50.0::DOUBLE, 1) * 10)
   WHEN 'official_docs' THEN list_contains(s.kws, lower(r.tag))::INT / len(s.kws) * 50.0::DOUBLE + CASE WHEN r.language <> '' AND contains(s.lang, r.language) THEN 30 ELSE 0 END
   ELSE len(list_intersect(s.kws, string_split(lower(r.repo), '/'))) / len(s.kws) * 40.0::DOUBLE + CASE WHEN contains(lower(r.repo), s.lang) THEN 30 ELSE 0 END END AS score
  FROM signed s, resources r WHERE len(s.kws) > 0),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, rid) AS rank FROM scored WHERE score > 0) WHERE rank <= 5)"""


@query("matched_resources", f"WITH {SCORED} SELECT uid, rid, source, round(score, 6) AS score, rank FROM top")
def matched_resources(spark, sf):
    out = enrichment.match_resources(view(spark, sf, "questions"), resources(spark, sf))
    return out.select("uid", "rid", "source", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


# Pairs that the text term cannot lift to the fifth best score without it are left out.
BY_TEXT = SCORED.replace("top AS (", "top_fixed AS (") + f""", weighed AS (SELECT s.uid, s.rid, s.score, CASE s.source WHEN 'github_repo' THEN 30 ELSE 20 END AS weight,
   lower(left(q.instruction, 100)) AS a, lower(left(coalesce(r.title, ''), 100)) AS b FROM scored s JOIN questions q USING (uid) JOIN resources r USING (rid)),
 able AS (SELECT w.* FROM weighed w LEFT JOIN (SELECT uid, score AS fifth FROM top_fixed WHERE rank = 5) f USING (uid) WHERE w.score + w.weight >= coalesce(fifth, 0)),
 pairs AS (SELECT uid AS aid, a, rid AS bid, b FROM able WHERE a <> '' AND b <> ''), {RATIO},
 full_score AS (SELECT w.uid, w.rid, w.score + w.weight * coalesce(t.ratio, 0) AS score FROM able w LEFT JOIN ratios t ON t.aid = w.uid AND t.bid = w.rid),
 best AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, rid) AS rank FROM full_score WHERE score > 0)"""


@query("matched_resources_by_text", f"WITH {BY_TEXT} SELECT uid, rid, round(score, 6) AS score, rank FROM best WHERE rank <= 5")
def matched_resources_by_text(spark, sf):
    """Full score with text similarity."""
    out = enrichment.match_resources_by_text(view(spark, sf, "questions"), resources(spark, sf))
    return out.select("uid", "rid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def issue_table(spark, sf):
    tasks = enrichment.collected_issues(view(spark, sf, "issues"))
    return tasks.select(
        F.col("number").alias("rid"), "category", "instruction", "difficulty", "language", "source_name",
        F.col("source").alias("url"),
    )


RELATED = f"""{TASKS}, pairs AS (SELECT q.uid AS aid, lower(left(q.instruction, 200)) AS a, t.number AS bid, lower(left(t.instruction, 200)) AS b
  FROM questions q, tasks t WHERE q.instruction <> '' AND t.instruction <> ''), {RATIO},
 judged AS (SELECT q.uid, t.number AS rid, q.category = t.category AS same, CASE WHEN q.category = t.category THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END * coalesce(r.ratio, 0) AS score
  FROM questions q CROSS JOIN tasks t LEFT JOIN ratios r ON r.aid = q.uid AND r.bid = t.number),
 related AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, same DESC, rid) AS rank FROM judged) WHERE rank <= 3)"""


@query("related_issues", f"WITH {RELATED} SELECT uid, rid, round(score, 6) AS score, rank FROM related")
def related_issues(spark, sf):
    """Category-weighted text similarity."""
    out = enrichment.match_issues(view(spark, sf, "questions"), issue_table(spark, sf))
    return out.select("uid", "rid", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("issue_prompts", f"""WITH {RELATED}, listed AS (SELECT r.uid, string_agg(chr(10) || r.rank || '. **' || left(string_split(t.instruction, chr(10))[1], 80) || '**' || chr(10)
  || '   - Source: ' || t.source_name || chr(10) || '   - Difficulty: ' || t.difficulty || chr(10) || '   - Language: ' || t.language || chr(10)
  || '   - Link: ' || t.source || chr(10), '' ORDER BY r.rank) AS entries FROM related r JOIN tasks t ON t.number = r.rid GROUP BY r.uid)
SELECT q.uid, q.category, q.instruction || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**Related Real-World Examples from GitHub:**' || chr(10) || entries, '') AS enriched
FROM questions q LEFT JOIN listed USING (uid)""")
def issue_prompts(spark, sf):
    questions, issues = view(spark, sf, "questions"), issue_table(spark, sf)
    return enrichment.issue_prompts(questions, enrichment.match_issues(questions, issues), issues)


@query("capped_per_source", f"""WITH {SCORED} SELECT uid, rid, source, rank, source_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY uid, source ORDER BY rank) AS source_rank FROM top) WHERE source_rank <= 2""")
def capped_per_source(spark, sf):
    out = enrichment.capped_per_source(matched_resources(spark, sf))
    return out.select("uid", "rid", "source", "rank", F.col("source_rank").cast("bigint").alias("source_rank"))


ENTRY = """CASE t.source WHEN 'stackoverflow' THEN chr(10) || '**' || left(r.title, 80) || '**' || chr(10) || '👍 ' || r.votes || ' votes | 💬 ' || r.answer_count || ' answers' || chr(10)
 WHEN 'official_docs' THEN chr(10) || '**' || r.title || '**' || chr(10) || 'Topics: ' || r.tag || chr(10) ELSE chr(10) || '**' || r.repo || '** - ' || r.title || chr(10) END
 || '🔗 https://example.com/' || r.rid || chr(10) || '_Relevance: ' || printf('%.1f', t.score) || '/100_' || chr(10)"""


@query("enriched_prompts", f"""WITH {SCORED}, c AS (SELECT *, row_number() OVER (PARTITION BY uid, source ORDER BY rank) AS sr FROM top),
 e AS (SELECT t.uid, t.source, t.sr, {ENTRY} AS entry FROM c t JOIN resources r USING (rid) WHERE t.sr <= 2),
 s AS (SELECT uid, source, CASE source WHEN 'stackoverflow' THEN 1 WHEN 'official_docs' THEN 2 ELSE 3 END AS o,
  chr(10) || CASE source WHEN 'stackoverflow' THEN '### 💬 Stack Overflow Q&A' WHEN 'official_docs' THEN '### 📖 Official Documentation' ELSE '### 🐙 Code Examples' END
  || chr(10) || string_agg(entry, '' ORDER BY sr) AS section FROM e GROUP BY uid, source),
 p AS (SELECT uid, string_agg(section, '' ORDER BY o) AS sections FROM s GROUP BY uid)
SELECT q.uid, q.category, CASE WHEN sections IS NULL THEN instruction ELSE instruction || chr(10) || chr(10) || repeat('=', 80) || chr(10)
 || '📚 **HELPFUL RESOURCES & REFERENCES**' || chr(10) || repeat('=', 80) || chr(10) || sections || chr(10) || repeat('=', 80) END AS enriched
FROM questions q LEFT JOIN p USING (uid)""")
def enriched_prompts(spark, sf):
    questions, table = view(spark, sf, "questions"), resources(spark, sf)
    matches = enrichment.match_resources(questions, table)
    return enrichment.enriched_prompts(questions, matches, table)


def packages(spark, sf):
    questions, table = view(spark, sf, "questions"), resources(spark, sf)
    return enrichment.packaged(questions, enrichment.match_resources(questions, table), table)


@query("packaged_tasks", f"""WITH {SCORED} SELECT q.uid, q.category, count(t.rid) AS num_resources,
 coalesce(string_agg(t.source || ':' || r.title, '|' ORDER BY t.rank), '') AS titles FROM questions q LEFT JOIN top t USING (uid) LEFT JOIN resources r ON r.rid = t.rid GROUP BY ALL""")
def packaged_tasks(spark, sf):
    titles = F.transform("enrichment.mapped_resources", lambda r: F.concat(r["source"], F.lit(":"), r["title"]))
    return packages(spark, sf).select(
        "uid", "category", F.col("enrichment.num_resources").cast("bigint").alias("num_resources"),
        F.coalesce(F.array_join(titles, "|"), F.lit("")).alias("titles"),
    )


@query("enrichment_stats", f"""WITH {SCORED}, n AS (SELECT q.uid, q.category, count(t.rid) AS n FROM questions q LEFT JOIN top t USING (uid) GROUP BY ALL)
SELECT category, count(*) AS tasks, round(avg(n), 2) AS mean_resources FROM n GROUP BY category""")
def enrichment_stats(spark, sf):
    return enrichment.enrichment_stats(packages(spark, sf))


# ------------------------------------------------------------------ collections

def tasks(spark, sf):
    return enrichment.collected_issues(view(spark, sf, "issues"))


@query("collected_issues", f"WITH {TASKS} SELECT uid, instruction, category, difficulty, language, source_name, source, author FROM tasks")
def collected_issues(spark, sf):
    return tasks(spark, sf).select("uid", "instruction", "category", "difficulty", "language", "source_name", "source", "author")


@query("issues_per_repo", f"""WITH {TASKS} SELECT repo, uid, position FROM (SELECT repo, uid, row_number() OVER (PARTITION BY repo ORDER BY label_pos, number) AS position FROM tasks)
WHERE position <= 10""")
def issues_per_repo(spark, sf):
    out = enrichment.capped_per_repo(tasks(spark, sf), 10)
    return out.select("repo", "uid", F.col("position").cast("bigint").alias("position"))


@query("csv_preview", f"""WITH {TASKS} SELECT uid, replace(replace(left(instruction, 150), chr(10), ' '), chr(13), '') || CASE WHEN length(instruction) > 150 THEN '...' ELSE '' END AS preview FROM tasks""")
def csv_preview(spark, sf):
    from verdictframe.sources.sinks import csv_rows

    return csv_rows(tasks(spark, sf)).select("uid", "preview")


@query("task_shares", f"""WITH {TASKS}, s AS (SELECT 'category' AS dimension, category AS value, count(*) AS n FROM tasks GROUP BY ALL UNION ALL
 SELECT 'repository', source_name, count(*) FROM tasks GROUP BY ALL)
SELECT dimension, value, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM tasks), 6) AS share_pct FROM s""")
def task_shares(spark, sf):
    rows = tasks(spark, sf)
    by_category = quality.shares(rows, "category").select(
        F.lit("category").alias("dimension"), F.col("category").alias("value"), "n", "share_pct"
    )
    by_repo = quality.shares(rows, "source_name").select(
        F.lit("repository").alias("dimension"), F.col("source_name").alias("value"), "n", "share_pct"
    )
    return by_category.unionByName(by_repo).withColumn("share_pct", F.round("share_pct", 6))


@query("task_report", f"""WITH {TASKS} SELECT category, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tasks), 1) AS percentage,
 count(DISTINCT repo) AS repositories, min(uid) AS first_uid FROM tasks GROUP BY category""")
def task_report(spark, sf):
    from verdictframe.sources.sinks import category_report

    rows = tasks(spark, sf)
    report = category_report(rows)
    extra = rows.groupBy("category").agg(F.count_distinct("repo").alias("repositories"), F.min("uid").alias("first_uid"))
    return report.join(extra, "category").select("category", "count", "percentage", "repositories", "first_uid")


@query("unique_urls", """WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, source FROM (SELECT page_id, url, page_id % 3 AS source FROM pages
 UNION ALL SELECT page_id + 100000, url, 9 FROM pages))
SELECT url, min(page_id) AS page_id FROM u GROUP BY url""")
def unique_urls(spark, sf):
    """First-seen resource per address."""
    pages = view(spark, sf, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    again = pages.withColumn("page_id", F.col("page_id") + 100000)
    return battles.earliest(pages.unionByName(again).select("url", "page_id"), ["url"], "page_id")


@query("curated_docs", """SELECT DISTINCT 'docs-' || lang || '-' || replace(lower('Guide To ' || source), ' ', '-') AS uid, 'cat' || doc_id % 6 AS category,
 'Guide To ' || source AS title, lang AS language FROM documents""")
def curated_docs(spark, sf):
    docs = view(spark, sf, "documents").select(
        F.concat(F.lit("cat"), (F.col("doc_id") % 6).cast("string")).alias("category"), "lang", "source"
    ).distinct()
    none = F.lit(None).cast("string")
    doc = F.struct(
        F.concat(F.lit("Guide To "), "source").alias("title"), F.concat(F.lit("https://"), "source").alias("url"),
        F.array("source").alias("topics"), none.alias("language"),
    )
    listed = docs.groupBy("category", "lang").agg(F.collect_list(doc).alias("docs"))
    table = listed.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("lang", "docs"))).alias("languages"))
    return enrichment.curated_docs(table).select("uid", "category", "title", "language")
