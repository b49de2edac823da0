"""Code extraction, environment routing, package and answer-quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdictframe.functions import codeblocks as cb
from verdictframe.operators import codejobs as jobs
from verdictframe.plans.registry import query
from verdictframe.sources.views import view


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


FENCE = q(r"(?s)```([\w+#\-.]*)[ \t]*\r?\n?(.*?)```")
STRIP = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"


def stripped(column: str) -> str:
    return f"regexp_replace({column}, {q(f'^{STRIP}+|{STRIP}+$')}, '', 'g')"


def main_block_sql(source: str) -> str:
    """CTEs ending in ``main(uid, lang, code)``: the chosen block per answer."""
    return f"""
 found AS (SELECT uid, regexp_extract_all(answer, {FENCE}, 1) AS l, regexp_extract_all(answer, {FENCE}, 2) AS c FROM {source}),
 blocks AS (SELECT uid, i, lower(l[i]) AS lang, c[i] AS raw, {stripped('c[i]')} AS code
   FROM (SELECT uid, l, c, unnest(range(1, len(l) + 1)) AS i FROM found)),
 graded AS (SELECT *, lang NOT IN ('bash','shell','sh','zsh','powershell','pwsh','') AND length(code) > 0 AS real FROM blocks),
 main AS (SELECT uid, lang, code FROM graded QUALIFY row_number() OVER (PARTITION BY uid
   ORDER BY real DESC, CASE WHEN real THEN length(code) ELSE length(raw) END DESC, i) = 1)"""


@query("code_blocks", f"""WITH {main_block_sql('answers')}
SELECT a.uid, m.lang AS block_lang, m.code FROM answers a LEFT JOIN main m USING (uid)""")
def code_blocks(spark, sf):
    answers = view(spark, sf, "answers")
    main = cb.main_block(cb.fenced_blocks(F.col("answer")))
    return answers.select("uid", main.alias("m")).select(
        "uid", F.col("m.lang").alias("block_lang"), F.col("m.code").alias("code")
    )


@query("code_blocks_all_languages", f"""WITH {main_block_sql('code_answers')} SELECT uid, lang AS block_lang, code FROM main""")
def code_blocks_all_languages(spark, sf):
    answers = view(spark, sf, "code_answers")
    main = cb.main_block(cb.fenced_blocks(F.col("answer")))
    return answers.select("uid", main.alias("m")).select(
        "uid", F.col("m.lang").alias("block_lang"), F.col("m.code").alias("code")
    )


SHELL = "CASE doc_id % 4 WHEN 0 THEN 'bash' WHEN 1 THEN 'sh' ELSE 'markdown' END"
ENVIRONMENT = """CASE doc_id % 17 WHEN 0 THEN 'Python Runner' WHEN 1 THEN 'PyGame' WHEN 2 THEN 'Vue' WHEN 3 THEN 'React'
 WHEN 4 THEN 'React' WHEN 5 THEN 'HTML' WHEN 6 THEN 'Javascript Runner' WHEN 7 THEN 'Vue' WHEN 8 THEN 'Mermaid' WHEN 9 THEN 'C++ Runner'
 WHEN 10 THEN 'C++ Runner' WHEN 11 THEN 'Golang Runner' WHEN 12 THEN 'Java Runner' WHEN 13 THEN 'Rust Runner' WHEN 14 THEN 'C Runner'
 WHEN 16 THEN 'Streamlit' END"""
LANGUAGE = f"""CASE doc_id % 17 WHEN 0 THEN 'python' WHEN 1 THEN 'py' WHEN 2 THEN 'javascript' WHEN 3 THEN 'javascript'
 WHEN 4 THEN 'typescript' WHEN 5 THEN 'html' WHEN 6 THEN 'javascript' WHEN 7 THEN 'typescript' WHEN 8 THEN 'markdown' WHEN 9 THEN 'cpp'
 WHEN 10 THEN 'cpp' WHEN 11 THEN 'go' WHEN 12 THEN 'java' WHEN 13 THEN 'rust' WHEN 14 THEN 'c' WHEN 15 THEN {SHELL} ELSE 'python3' END"""


@query("code_environments", f"SELECT doc_id AS uid, {LANGUAGE} AS language, {ENVIRONMENT} AS environment FROM documents")
def code_environments(spark, sf):
    """The expected route of every constructed block is known by its tag."""
    return jobs.extract_code(view(spark, sf, "code_answers")).select("uid", "language", "environment")


@query("environment_counts", f"SELECT {ENVIRONMENT} AS environment, count(*) AS n FROM documents GROUP BY 1")
def environment_counts(spark, sf):
    rows = jobs.extract_code(view(spark, sf, "code_answers"))
    return rows.groupBy("environment").agg(F.count(F.lit(1)).alias("n"))


@query("code_dependencies", """WITH d AS (SELECT doc_id AS uid,
 list_concat(CASE doc_id % 17 WHEN 0 THEN ['numpy', 'pandas'] WHEN 1 THEN ['pygame', 'rich', 'requests', 'requests>=2.0'] WHEN 16 THEN ['streamlit'] ELSE [] END,
  CASE WHEN doc_id % 4 = 0 AND doc_id % 17 <> 15 THEN ['torch', 'scikit-learn>=1.0', source] ELSE [] END) AS py,
 list_concat(CASE doc_id % 17 WHEN 2 THEN ['axios'] WHEN 3 THEN ['react', 'lodash'] WHEN 4 THEN ['@mui/material']
   WHEN 5 THEN ['vue', '@scope/kit@2', 'jquery-3', 'd3'] WHEN 6 THEN ['fs-extra'] WHEN 7 THEN ['vue'] ELSE [] END,
  CASE WHEN doc_id % 17 = 15 THEN [] WHEN doc_id % 4 = 0 THEN ['react', '@types/node@16.0.0'] WHEN doc_id % 4 = 1 THEN ['three', 'd3'] ELSE [] END) AS npm
 FROM documents)
SELECT uid, array_to_string(list_sort(list_distinct(py)), ',') AS python, array_to_string(list_sort(list_distinct(npm)), ',') AS npm FROM d""")
def code_dependencies(spark, sf):
    rows = jobs.extract_code(view(spark, sf, "code_answers"))
    return rows.select(
        "uid",
        F.array_join(F.array_sort("code_dependencies.python"), ",").alias("python"),
        F.array_join(F.array_sort("code_dependencies.npm"), ",").alias("npm"),
    )


STDLIB_VALUES = ", ".join(f"({q(n)})" for n in cb.STDLIB)


def has_prefix(prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with(lang, {q(p)})" for p in prefixes) + ")"


# The lexemes again, for an engine without look-around and possessive repeats.
PYTHON_LEXEMES = q(r"""(?s:#[^\n\r]*|("")".*?\"\"\"|('')'.*?\'\'\'|(")(?:[^"\\\n]|\\.)*"|(')(?:[^'\\\n]|\\.)*')""")
SCRIPT_LEXEMES = q(
    r"""(?s://[^\n\r]*|/\*.*?\*/|\b(?:import|from)\s*["']([^"'\n\\]+)["']|\brequire\s*\(\s*["']([^"'\n\\]+)["']"""
    r"""|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)"""
)
SCRIPTS = cb.VUE_PREFIXES + cb.REACT_PREFIXES + cb.JS_PREFIXES + cb.TS_PREFIXES + cb.HTML_PREFIXES


def main_blocks(spark, sf, prefixes: list[str]):
    """The main blocks of the languages, one row per answer."""
    rows = code_blocks_all_languages(spark, sf)
    return rows.filter(cb.starts_with_any(F.col("block_lang"), prefixes))


@query("python_package_usage", f"""WITH {main_block_sql('code_answers')}, stdlib(name) AS (VALUES {STDLIB_VALUES}),
 bare AS (SELECT uid, regexp_replace(code, {PYTHON_LEXEMES}, {q(chr(92) + '1' + chr(92) + '2' + (chr(92) + '3') * 2 + (chr(92) + '4') * 2)}, 'g') AS code
  FROM main WHERE {has_prefix(cb.PYTHON_PREFIXES)}),
 line AS (SELECT uid, unnest(regexp_extract_all(code, {q(cb.PYTHON_IMPORT)}, 1)) AS items FROM bare),
 direct AS (SELECT uid, unnest(string_split(items, ',')) AS item FROM line),
 pk AS (SELECT uid, regexp_extract(item, {q(r'^\s*(\w+)')}, 1) AS package FROM direct
  UNION SELECT uid, string_split(unnest(regexp_extract_all(code, {q(cb.PYTHON_FROM)}, 1)), '.')[1] FROM bare)
SELECT package, 'python' AS kind, count(*) AS n FROM pk WHERE package <> '' AND package NOT IN (SELECT name FROM stdlib) GROUP BY package""")
def python_package_usage(spark, sf):
    rows = main_blocks(spark, sf, cb.PYTHON_PREFIXES)
    return jobs.package_usage(rows, cb.python_imports(F.col("code")), "python")


@query("npm_package_usage", f"""WITH {main_block_sql('code_answers')},
 src AS (SELECT uid, CASE WHEN regexp_matches(code, '(?s)<script.*?>.*?</script>')
   THEN regexp_extract(code, '(?s)<script.*?>(.*?)</script>', 1) ELSE code END AS code FROM main WHERE {has_prefix(SCRIPTS)}),
 p AS (SELECT uid, unnest(list_concat(regexp_extract_all(code, {SCRIPT_LEXEMES}, 1), regexp_extract_all(code, {SCRIPT_LEXEMES}, 2))) AS path FROM src),
 n AS (SELECT DISTINCT uid, CASE WHEN path LIKE '@%' THEN array_to_string(string_split(path, '/')[1:2], '/')
   ELSE string_split(path, '/')[1] END AS package FROM p WHERE path <> '' AND NOT (path LIKE '.%' OR path LIKE '/%' OR path LIKE '@/%' OR contains(path, '://')))
SELECT package, 'npm' AS kind, count(*) AS n FROM n GROUP BY package""")
def npm_package_usage(spark, sf):
    return jobs.package_usage(main_blocks(spark, sf, SCRIPTS), cb.npm_imports(F.col("code")), "npm")


@query("script_tag_usage", """WITH n AS (SELECT doc_id, unnest(CASE doc_id % 17 WHEN 5 THEN ['vue', '@scope/kit@2', 'jquery-3', 'd3'] WHEN 2 THEN ['axios'] ELSE [] END) AS package FROM documents)
SELECT package, 'npm' AS kind, count(*) AS n FROM n GROUP BY package""")
def script_tag_usage(spark, sf):
    answers = view(spark, sf, "code_answers")
    return jobs.package_usage(answers, cb.script_tag_packages(F.col("answer")), "npm")


@query("page_script_packages", f"""WITH h AS (SELECT page_id, replace(html, '<head>', '<head><script src="https://unpkg.com/' ||
   CASE page_id % 3 WHEN 0 THEN 'htmx.org@1.9' WHEN 1 THEN '@alpine/core@3/x.js' ELSE 'lit' END || '"></script>') AS html FROM pages),
 u AS (SELECT page_id, unnest(regexp_extract_all(html, {q(cb.SCRIPT_URL)}, 1)) AS url FROM h),
 n AS (SELECT DISTINCT page_id, CASE WHEN url LIKE '%@alpine%' THEN unnest(['@alpine/core@3', '@alpine'])
   WHEN url LIKE '%htmx%' THEN unnest(['htmx.org', 'htmx']) ELSE 'lit' END AS package FROM u)
SELECT package, 'npm' AS kind, count(*) AS n FROM n GROUP BY package""")
def page_script_packages(spark, sf):
    tag = F.concat(
        F.lit('<head><script src="https://unpkg.com/'),
        F.when(F.col("page_id") % 3 == 0, "htmx.org@1.9").when(F.col("page_id") % 3 == 1, "@alpine/core@3/x.js").otherwise("lit"),
        F.lit('"></script>'),
    )
    pages = view(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("<head>"), tag))
    return jobs.package_usage(pages, cb.cdn_packages(F.col("html")), "npm")


@query("install_commands", """WITH d AS (SELECT doc_id AS uid, CASE doc_id % 4 WHEN 0 THEN list_concat(CASE WHEN doc_id % 17 = 1 THEN ['rich', 'requests>=2.0'] ELSE [] END, ['torch', 'scikit-learn>=1.0', source]) WHEN 1 THEN CASE WHEN doc_id % 17 = 1 THEN ['rich', 'requests>=2.0'] ELSE [] END
  ELSE CASE WHEN doc_id % 17 = 1 THEN ['rich', 'requests>=2.0'] ELSE [] END END AS py,
 CASE doc_id % 4 WHEN 0 THEN ['react', '@types/node@16.0.0'] WHEN 1 THEN ['three', 'd3'] ELSE [] END AS npm FROM documents)
SELECT uid, array_to_string(py, ' ') AS python, array_to_string(npm, ' ') AS npm FROM d""")
def install_commands(spark, sf):
    python, npm = cb.install_packages(F.col("answer"))
    return view(spark, sf, "code_answers").select(
        "uid", F.array_join(python, " ").alias("python"), F.array_join(npm, " ").alias("npm")
    )


@query("inline_pip", f"""WITH {main_block_sql('code_answers')}
SELECT uid, CASE uid % 17 WHEN 0 THEN 'numpy' WHEN 1 THEN 'rich requests' ELSE '' END AS packages,
 array_to_string(list_filter(string_split(code, chr(10)), lambda s: s NOT LIKE '%pip install%'), chr(10)) AS cleaned
FROM main WHERE {has_prefix(cb.PYTHON_PREFIXES)}""")
def inline_pip(spark, sf):
    code = F.col("code")
    return main_blocks(spark, sf, cb.PYTHON_PREFIXES).select(
        "uid", F.array_join(cb.inline_pip_packages(code), " ").alias("packages"), cb.without_inline_pip(code).alias("cleaned")
    )


@query("java_class_names", f"""WITH {main_block_sql('code_answers')}
SELECT uid, coalesce(nullif(regexp_extract(code, {q(cb.JAVA_CLASS)}, 1), ''), 'Main') AS class_name FROM main""")
def java_class_names(spark, sf):
    return code_blocks_all_languages(spark, sf).select("uid", cb.java_class_name(F.col("code")).alias("class_name"))


@query("placeholder_urls", f"""WITH m AS (SELECT uid, unnest(regexp_extract_all(answer, {q(cb.PLACEHOLDER)}, 0)) AS url FROM code_answers),
 s AS (SELECT uid, url, string_split(url, '/')[4]::BIGINT AS w, string_split(url, '/')[5]::BIGINT AS h FROM m)
SELECT uid, url, CASE WHEN w <= 0 OR h <= 0 THEN 100 WHEN w > 10000 OR h > 10000 THEN least(w, 1000) ELSE w END AS width,
 CASE WHEN w <= 0 OR h <= 0 THEN 100 WHEN w > 10000 OR h > 10000 THEN least(h, 1000) ELSE h END AS height FROM s""")
def placeholder_urls(spark, sf):
    rows = view(spark, sf, "code_answers").select("uid", F.explode(cb.placeholders(F.col("answer"))).alias("p"))
    return rows.select("uid", "p.*")


@query("joined_code_blocks", f"""WITH b AS (SELECT uid, answer, regexp_extract_all(answer, {q(r'(?s)```(?:\w+)?\n(.*?)```')}, 1) AS c FROM answers)
SELECT uid, CASE WHEN len(c) > 0 THEN array_to_string(c, chr(10) || chr(10)) ELSE answer END AS code FROM b""")
def joined_code_blocks(spark, sf):
    return view(spark, sf, "answers").select("uid", cb.joined_blocks(F.col("answer")).alias("code"))


FALLBACK = """CASE
 WHEN regexp_matches(s, '^(<!doctype|<html|<!DOCTYPE|<HTML)') THEN 'HTML'
 WHEN contains(c, 'height: 100vh') OR contains(c, 'width: 100%') OR contains(c, '<style>') THEN 'HTML'
 WHEN contains(c, 'import React') OR contains(l, 'from react') OR contains(c, 'import * as React') THEN 'React'
 WHEN contains(l, 'import streamlit') THEN 'Streamlit' WHEN contains(l, 'import pygame') THEN 'PyGame'
 WHEN contains(l, 'import vue') OR contains(l, 'from vue') OR contains(c, '<template>') THEN 'Vue'
 WHEN contains(l, 'import gradio') THEN 'Gradio'
 WHEN contains(l, 'mermaid') AND (contains(l, 'graph') OR contains(l, 'flowchart')) THEN 'Mermaid'
 WHEN contains(l, 'three') OR contains(c, 'OrbitControls') THEN 'React'
 WHEN contains(l, '<svg') OR contains(l, 'canvas') THEN 'HTML'
 WHEN contains(c, '//') OR contains(c, '/*') THEN CASE WHEN contains(c, 'def ') OR contains(c, 'class ') OR contains(c, 'import ') THEN 'Python Runner' ELSE 'React' END
 ELSE 'Python Runner' END"""
SOLUTION = "regexp_replace(answer, '```[a-zA-Z0-9+]*', '', 'g')"


@query("fallback_environments", f"""WITH t AS (SELECT uid, {SOLUTION} AS c FROM code_answers),
 u AS (SELECT uid, c, lower(c) AS l, {stripped('c')} AS s FROM t),
 p AS (SELECT page_id + 1000000 AS uid, html AS c, lower(html) AS l, {stripped('html')} AS s FROM pages)
SELECT uid, {FALLBACK} AS environment FROM u UNION ALL SELECT uid, {FALLBACK} FROM p""")
def fallback_environments(spark, sf):
    """Answers with their fence marks removed, and raw pages."""
    bare = view(spark, sf, "code_answers").select(
        "uid", F.regexp_replace("answer", "```[a-zA-Z0-9+]*", "").alias("solution")
    )
    pages = view(spark, sf, "pages").select((F.col("page_id") + 1000000).alias("uid"), F.col("html").alias("solution"))
    return jobs.generations_from_solutions(bare.unionByName(pages)).select("uid", "environment")


@query("reclassified_environments", f"""WITH d AS (SELECT doc_id AS uid, CASE WHEN doc_id % 3 = 0 THEN 'HTML' ELSE 'React' END AS old_environment, {ENVIRONMENT} AS e FROM documents)
SELECT uid, old_environment, coalesce(e, old_environment) AS new_environment, coalesce(e, old_environment) <> old_environment AS changed FROM d""")
def reclassified_environments(spark, sf):
    stored = view(spark, sf, "code_answers").withColumn(
        "environment", F.when(F.col("uid") % 3 == 0, "HTML").otherwise("React")
    )
    return jobs.reclassified(stored, "answer")


@query("regeneration_worklist", """SELECT uid, CASE WHEN trim(answer) = '' THEN 'empty' ELSE 'no_code' END AS reason FROM answers
WHERE trim(answer) = '' OR NOT contains(answer, '```')""")
def regeneration_worklist(spark, sf):
    return jobs.empty_answers(view(spark, sf, "answers")).select("uid", "reason")


@query("execution_validity", f"""WITH {main_block_sql('code_answers')}
SELECT uid, CASE WHEN uid % 17 IN (8, 15) THEN 'Missing required fields' WHEN coalesce(code, '') = '' OR uid % 17 = 14 THEN 'No code to execute' END AS problem FROM main""")
def execution_validity(spark, sf):
    rows = jobs.extract_code(view(spark, sf, "code_answers"))
    rows = rows.withColumn("environment", F.when(F.col("environment") != "Mermaid", F.col("environment")))
    rows = rows.withColumn("code_to_execute", F.when(F.col("environment") != "C Runner", F.col("code_to_execute")))
    return jobs.execution_validity(rows).select("uid", "problem")


DEPENDENCY_CASES = """CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'Each dependency must have type, package and version fields'
 WHEN 2 THEN 'Invalid dependency type: gem' WHEN 3 THEN 'Invalid Python version format for ' || source || ': 1.0'
 WHEN 4 THEN 'Invalid NPM version format for ' || source || ': 2' ELSE '' END"""


@query("dependency_problems", f"SELECT doc_id, {DEPENDENCY_CASES} AS problem FROM documents")
def dependency_problems(spark, sf):
    docs = view(spark, sf, "documents")
    ok = F.array(F.lit("python"), F.lit("numpy"), F.lit("==1.0"))

    def row(*parts):
        return F.array(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    case = F.col("doc_id") % 7
    rows = (
        F.when(case == 0, F.array(ok, row("npm", "d3", "@7")))
        .when(case == 1, F.array(ok, row("python", "x")))
        .when(case == 2, F.array(ok, row("gem", F.col("source"), "")))
        .when(case == 3, F.array(row("Python", F.col("source"), "1.0"), row("gem", "x", "")))
        .when(case == 4, F.array(row("npm", F.col("source"), "2")))
        .when(case == 5, F.array(row("gem", " ", "9"), ok))
        .otherwise(F.array(row("npm", "d3", "Latest")))
    )
    return docs.select("doc_id", cb.dependency_problem(rows).alias("problem"))
