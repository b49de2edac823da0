"""Input views derived from the given tables.

Each view is one SQL text valid in Spark and in DuckDB. ``{name}`` marks a table
or another view. ``seq`` columns are unique, so they can serve as order keys.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["battles"] = """
SELECT event_id AS seq, ts, concat('m', lpad(cast(user_id % 12 AS string), 2, '0')) AS model_a,
  concat('m', lpad(cast((user_id + 1 + event_id % 11) % 12 AS string), 2, '0')) AS model_b,
  CASE WHEN event_type = 'error' THEN 'vote_both_bad' WHEN event_type = 'signup' THEN 'vote_tie'
       WHEN (user_id % 12) * 8 + value > 95 THEN 'vote_left' ELSE 'vote_right' END AS vote,
  concat('cat', cast(event_id % 6 AS string)) AS category
FROM {events}
"""

# Four judge systems: two judges, each with and without execution results.
VIEWS["judgments"] = """
SELECT CASE WHEN v < 2 THEN 'jA' ELSE 'jB' END AS judge,
  CASE WHEN v % 2 = 0 THEN 'with_execution' ELSE 'without_execution' END AS mode,
  seq, model_a, model_b, category, vote AS human_vote,
  CASE WHEN (seq * 7919 + v + 1) % 100 < CASE v WHEN 0 THEN 80 WHEN 1 THEN 60 WHEN 2 THEN 70 ELSE 65 END THEN vote
       WHEN vote = 'vote_left' THEN 'vote_right' WHEN vote = 'vote_right' THEN 'vote_tie'
       WHEN vote = 'vote_tie' THEN 'vote_both_bad' ELSE 'vote_left' END AS judge_vote
FROM (SELECT *, <each:4> AS v FROM {battles}) b
"""

VIEWS["system_battles"] = """
SELECT 'Human Votes' AS system, seq, model_a, model_b, vote FROM {battles}
UNION ALL
SELECT concat(judge, ' (', mode, ')') AS system, seq, model_a, model_b, judge_vote AS vote FROM {judgments}
"""

VIEWS["raw_votes"] = """
SELECT seq, concat('s', cast(seq - CASE WHEN seq % 40 = 39 THEN 1 ELSE 0 END AS string)) AS chat_session_id,
  CASE WHEN seq % 43 = 0 THEN '' ELSE model_a END AS model_a, model_b, category,
  CASE WHEN seq % 29 = 0 THEN NULL WHEN seq % 31 = 0 THEN '' WHEN seq % 37 = 0 THEN 'skip'
       WHEN vote = 'vote_left' THEN 'vote_model_A' WHEN vote = 'vote_right' THEN 'vote_model_B' ELSE vote END AS human_vote,
  CASE WHEN seq % 58 = 0 THEN 'vote_tie' END AS vote_type,
  CASE WHEN seq % 17 = 0 THEN NULL ELSE category END AS category_name
FROM {battles}
"""

VIEWS["judge_rows"] = """
SELECT judge, mode, seq, concat('s', cast(seq AS string)) AS chat_session_id, model_a, model_b,
  CASE WHEN seq % 53 = 0 THEN NULL WHEN seq % 59 = 0 THEN 'error'
       WHEN judge_vote = 'vote_left' THEN 'vote_model_A' WHEN judge_vote = 'vote_right' THEN 'vote_model_B'
       ELSE judge_vote END AS judgment
FROM {judgments}
"""

VIEWS["space_votes"] = """
SELECT seq, ts, model_a, model_b,
  CASE WHEN seq % 61 = 0 THEN 'flag' WHEN vote = 'vote_left' THEN 'left' WHEN vote = 'vote_right' THEN 'right'
       WHEN vote = 'vote_tie' THEN 'tie' ELSE 'both_bad' END AS vote
FROM {battles}
"""

VIEWS["games"] = """
SELECT seq AS uid, model_b AS model, category AS topic,
  CASE seq % 5 WHEN 0 THEN 'A>>B' WHEN 1 THEN 'A>B' WHEN 2 THEN 'A=B' WHEN 3 THEN 'B>A' ELSE 'B>>A' END AS score1,
  CASE WHEN seq % 97 = 0 THEN NULL WHEN vote = 'vote_left' THEN 'B>A' WHEN vote = 'vote_right' THEN 'A>B' ELSE 'A=B' END AS score2
FROM {battles}
"""

VIEWS["executions"] = """
SELECT event_id AS uid, concat('m', lpad(cast(user_id % 12 AS string), 2, '0')) AS model,
  CASE event_id % 5 WHEN 0 THEN 'HTML' WHEN 1 THEN 'React' WHEN 2 THEN 'Vue' WHEN 3 THEN 'PyGame' ELSE 'Python Runner' END AS environment,
  concat('cat', cast(event_id % 6 AS string)) AS category,
  CASE WHEN event_id % 50 = 0 THEN 'No code to execute' WHEN event_type = 'error' THEN 'Traceback: x' WHEN event_id % 11 = 0 THEN '  ' ELSE '' END AS stderr
FROM {events}
"""

VIEWS["answers"] = """
SELECT conv_id * 100 + turn AS uid, concat('cat', cast(conv_id % 6 AS string)) AS category,
  CASE turn % 4 WHEN 1 THEN concat('Try:', chr(10), '```python', chr(10), 'import pandas', chr(10), 'def f(x):', chr(10), '    return x # ', replace(text, chr(10), ' '), chr(10), '```', chr(10), '```bash', chr(10), 'pip install pandas==2.0', chr(10), '```')
   WHEN 3 THEN concat(text, ' class X(', CASE WHEN conv_id % 3 = 0 THEN ')' ELSE '' END) ELSE text END AS answer
FROM {conversations} WHERE role = 'assistant'
UNION ALL SELECT conv_id * 100 + 99, 'cat0', 'ERROR: 500' FROM {conversations} WHERE turn = 0 AND conv_id % 20 = 0
"""

VIEWS["questions"] = """
SELECT item_id AS uid, concat('cat', cast(item_id % 6 AS string)) AS category,
  concat(text, CASE item_id % 3 WHEN 0 THEN ' python array sort' WHEN 1 THEN ' react component css' ELSE ' tree search' END) AS instruction
FROM {benchmark}
"""

VIEWS["resources"] = """
SELECT doc_id AS rid, concat('cat', cast(doc_id % 6 AS string)) AS category,
  CASE doc_id % 3 WHEN 0 THEN 'stackoverflow' WHEN 1 THEN 'official_docs' ELSE 'github_repo' END AS source,
  text AS title, CASE doc_id % 4 WHEN 0 THEN 'array' WHEN 1 THEN 'react' WHEN 2 THEN 'tree' ELSE 'Sort' END AS tag,
  n_chars AS votes, doc_id % 60 AS answer_count, lang AS language, concat('acme/', source) AS repo
FROM {documents}
"""


# Answers whose fenced blocks cover every language family; the whole document
# text rides along as the closing paragraph.
VIEWS["code_answers"] = """
SELECT doc_id AS uid, concat('cat', cast(doc_id % 6 AS string)) AS category, lang AS model,
  concat('Answer ', cast(doc_id AS string), ':', chr(10), '```',
   CASE doc_id % 17 WHEN 0 THEN 'python' WHEN 1 THEN 'py' WHEN 2 THEN 'vue' WHEN 3 THEN 'jsx' WHEN 4 THEN 'react' WHEN 5 THEN 'html'
    WHEN 6 THEN 'json' WHEN 7 THEN 'typescript' WHEN 8 THEN 'mermaid' WHEN 9 THEN 'cpp' WHEN 10 THEN 'c++' WHEN 11 THEN 'golang'
    WHEN 12 THEN 'java' WHEN 13 THEN 'rust' WHEN 14 THEN 'c' WHEN 15 THEN '' ELSE 'Python3' END, chr(10),
   CASE doc_id % 17
    WHEN 0 THEN concat('# pip install numpy==1.26 --upgrade', chr(10), 'import os, numpy as np', chr(10), 'from pandas.core import frame', chr(10), repeat(chr(34), 3), chr(10), 'import trap_one', chr(10), repeat(chr(34), 3), chr(10),
      'note = "st and gr"  # import trap_two', chr(10), 'print(np.ones(', cast(doc_id AS string), '))')
    WHEN 1 THEN concat('import pygame', chr(10), '!pip install rich requests>=2.0', chr(10), 'pygame.init()')
    WHEN 2 THEN concat('<template><p>hi</p></template>', chr(10), '<script setup>', chr(10), 'import axios from "axios" // const x: number = 1; import "trap-three"', chr(10),
      'const row = "interface Row {{ }}";', chr(10), '</script>')
    WHEN 3 THEN concat('import React from "react";', chr(10), 'import {{ map }} from "lodash/map"; /* import "trap-four" */', chr(10), 'export default () => <div>x</div>;')
    WHEN 4 THEN concat('import {{ Button }} from "@mui/material/Button";', chr(10), 'const n: number = 4;')
    WHEN 5 THEN concat('<!DOCTYPE html><html><head><script src="https://unpkg.com/vue@3/dist/vue.js"></script>',
      '<script src="https://cdn.jsdelivr.net/npm/@scope/kit@2/x.js"></script><script src="https://code.example.com/jquery-3.6/a.js"></script></head><body><script>import "d3";</script></body></html>')
    WHEN 6 THEN concat('const v = require("fs-extra/lib");', chr(10), 'v.on("x", f); const t = "import (trap-five)"; // require("trap-six")')
    WHEN 7 THEN concat('interface Row {{ id: number }}', chr(10), 'import {{ ref }} from "vue";', chr(10), 'const img = "/api/placeholder/300/20000";')
    WHEN 8 THEN concat('graph TD; A-->B', cast(doc_id AS string))
    WHEN 9 THEN 'int main() {{ return 0; }}'
    WHEN 10 THEN '#include <vector>'
    WHEN 11 THEN 'package main'
    WHEN 12 THEN concat('public class Doc', cast(doc_id % 9 AS string), ' {{ }}')
    WHEN 13 THEN 'fn main() {{}}'
    WHEN 14 THEN concat('void f(void); // "/api/placeholder/0/40" and "/api/placeholder/640/480"')
    WHEN 15 THEN concat('plain block ', cast(doc_id AS string))
    ELSE concat('import streamlit as st', chr(10), 'st.title("', source, '")') END,
   chr(10), '```', chr(10),
   CASE doc_id % 4 WHEN 0 THEN concat('```bash', chr(10), 'pip install -U torch "scikit-learn>=1.0" ', source, chr(10), '# note', chr(10), 'npm install --save react @types/node@16.0.0', chr(10), '```', chr(10))
    WHEN 1 THEN concat('```sh', chr(10), 'yarn add three', chr(10), 'npm i d3', chr(10), '```', chr(10)) ELSE '' END,
   text) AS answer
FROM {documents}
"""

# Judge texts with verdict marks in all spellings.
VIEWS["verdict_texts"] = """
SELECT seq AS uid, category, vote, concat('Comparing ', model_a, ' with ', model_b, '. ',
  CASE seq % 8 WHEN 0 THEN 'First [[A>B]], on reflection [[B>A]].' WHEN 1 THEN 'Verdict [a=b] here.'
   WHEN 2 THEN 'No verdict given.' WHEN 3 THEN 'So [[a>>b]] beats the earlier [B<A].'
   WHEN 4 THEN 'My choice: [[B>>A]]' WHEN 5 THEN '[[]] then [A<B]' WHEN 6 THEN '[NOTE] and [[A<<B]]' ELSE '[x] only' END) AS judgment
FROM {battles}
"""

# Judge replies: clean JSON, fenced JSON, JSON in prose, plain words, noise.
VIEWS["judge_replies"] = """
SELECT seq AS uid, CASE seq % 16
  WHEN 0 THEN concat('{{"Overall": {{"winner": "A", "reasoning": "', model_a, '"}}}}')
  WHEN 1 THEN '{{"Overall": "b", "Style": {{"winner": "A"}}}}'
  WHEN 2 THEN concat('```json', chr(10), '{{"Overall": {{"winner": "TIE"}}}}', chr(10), '```')
  WHEN 3 THEN concat('```', chr(10), '{{"Overall": "both_bad"}}', chr(10), '```')
  WHEN 4 THEN concat('Here it is: {{"Overall": {{"winner": "B", "n": {{"x": ', cast(seq AS string), '}}}}}} and {{more}}')
  WHEN 5 THEN concat('  {{"Overall": {{"winner": "A", "reasoning": "it', chr(92), chr(39), 's fine"}}}}  ')
  WHEN 6 THEN concat('{{"Overall": {{"winner": "A", "reasoning": "uses ', chr(92), 'alpha"}}}}')
  WHEN 7 THEN '{{"Style": {{"winner": "A"}}}}'
  WHEN 8 THEN 'I would say vote_right overall.'
  WHEN 9 THEN concat('Model A is clearly Better than ', model_b)
  WHEN 10 THEN 'The two are equivalent to me.'
  WHEN 11 THEN 'Neither of them runs.'
  WHEN 12 THEN ''
  WHEN 13 THEN concat('Nothing to add on ', model_a)
  WHEN 14 THEN ' solution a '
  ELSE 'Broken {{"Overall": {{"winner": "A"}}' END AS reply
FROM {battles}
"""

# Assessments as XML, one per document; some malformed.
VIEWS["assessments"] = """
SELECT doc_id AS uid, concat('cat', cast(doc_id % 6 AS string)) AS category, text AS instruction,
  CASE WHEN doc_id % 11 = 0 THEN concat('no assessment ', source) ELSE concat('Sure.', chr(10), '<response>', chr(10), '<question_quality>', chr(10),
   '<reasoning> clear ', source, ' </reasoning>', chr(10), '<rating> ',
   CASE doc_id % 5 WHEN 0 THEN 'excellent' WHEN 1 THEN 'good' WHEN 2 THEN 'average' WHEN 3 THEN 'poor' ELSE 'very poor' END,
   ' </rating>', chr(10), '</question_quality>', chr(10), CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('<question_difficulty><rating>',
   CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'very hard' END, '</rating></question_difficulty>') END,
   chr(10), '</response> done') END AS response
FROM {documents}
"""

# Evaluation replies with a verdict object somewhere inside.
VIEWS["evaluations"] = """
SELECT seq AS uid, category, CASE seq % 6
  WHEN 0 THEN concat('{{"verdict": "PASS", "total_score": ', cast(60 + seq % 40 AS string), '}}')
  WHEN 1 THEN concat('Result: {{"verdict": "PARTIAL", "total_score": ', cast(seq % 60 AS string), ', "reasoning": "half"}} end')
  WHEN 2 THEN '{{"total_score": 12}}'
  WHEN 3 THEN 'no object'
  WHEN 4 THEN '{{broken'
  ELSE '{{"verdict": "UNSURE", "status": "late"}}' END AS response
FROM {battles}
"""

# Generated questions with the artefacts a generator leaves behind.
VIEWS["generated_texts"] = """
SELECT doc_id AS uid, concat('cat', cast(doc_id % 6 AS string)) AS category, concat(
  CASE doc_id % 8 WHEN 0 THEN concat('- Do NOT repeat.', chr(10), '- Use care.', chr(10)) WHEN 1 THEN '[Question 3]: ' WHEN 2 THEN '## '
   WHEN 3 THEN concat('Output only text.', chr(10)) WHEN 4 THEN concat('**Output it plainly**', chr(10)) WHEN 5 THEN concat('<|mark|> tail', chr(10))
   WHEN 6 THEN concat('  question 12:  ', '') ELSE '' END,
  CASE WHEN doc_id % 10 = 7 THEN '' ELSE concat('Task about ', source, '.', chr(10), chr(10), '  ', chr(10), '- bullet ', chr(10), 'End ', cast(doc_id AS string), chr(10), text) END) AS raw
FROM {documents}
"""

# Raw solutions and test lists as a generator returns them.
VIEWS["solutions"] = """
SELECT doc_id AS uid, concat('cat', cast(doc_id % 6 AS string)) AS category, concat(
  CASE doc_id % 4 WHEN 0 THEN concat('Note: provide only code.', chr(10), chr(10), 'Sure thing', chr(10)) WHEN 1 THEN concat('```python', chr(10))
   WHEN 2 THEN concat('Ensure the code def works', chr(10)) ELSE '' END,
  CASE doc_id % 5 WHEN 0 THEN concat('import os', chr(10), 'note: kept', chr(10)) WHEN 1 THEN concat('def f(x):', chr(10), '    return x', chr(10))
   WHEN 2 THEN concat('<div>', cast(doc_id AS string), '</div>', chr(10)) WHEN 3 THEN '' ELSE concat('const x = 1', chr(10), 'let y = 2', chr(10)) END,
  text, CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), '```') ELSE '' END) AS solution_text,
  CASE doc_id % 4 WHEN 0 THEN concat('Tests: [{{"input": ', cast(doc_id AS string), ', "expected_output": 1}}, {{"input": "a", "expected_output": [2]}}] end')
   WHEN 1 THEN '[]' WHEN 2 THEN 'none' ELSE '[{{"input": 1' END AS test_text
FROM {documents}
"""

# Program output with embedded pictures and pages.
VIEWS["outputs"] = """
SELECT page_id AS uid, concat('start ', url, chr(10),
  CASE WHEN page_id % 2 = 0 THEN concat('data:image/png;base64,iVBOR', cast(page_id AS string), '== ') ELSE '' END,
  CASE WHEN page_id % 3 = 0 THEN concat('data:image/jpeg;base64,/9j/', cast(page_id AS string), ' ') ELSE '' END,
  CASE WHEN page_id % 5 = 0 THEN concat('<svg width="4">', chr(10), '<g/></SVG>') ELSE '' END, html, chr(10), 'end') AS stdout
FROM {pages}
"""

# Repository issues and readme files.
VIEWS["issues"] = """
SELECT doc_id AS number, concat('team', cast(doc_id % 3 AS string), '/', CASE doc_id % 8 WHEN 0 THEN 'react-kit' WHEN 1 THEN 'PyTorch-x'
   WHEN 2 THEN 'java-lib' WHEN 3 THEN 'godot' WHEN 4 THEN 'algo-go' WHEN 5 THEN 'nuts' WHEN 6 THEN 'zzz' ELSE 'd3-more' END) AS repo,
  concat('Issue ', cast(doc_id AS string)) AS title, CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS body,
  doc_id % 7 = 0 AS is_pull_request, CASE doc_id % 4 WHEN 0 THEN 'Easy fix' WHEN 1 THEN 'advanced' WHEN 2 THEN 'good first issue' ELSE 'beginner,complex' END AS labels,
  doc_id % 3 AS label_pos, concat('user', cast(doc_id % 20 AS string)) AS author, concat('cat', cast(doc_id % 6 AS string)) AS category
FROM {documents}
"""

VIEWS["readmes"] = """
SELECT doc_id AS uid, concat('own', cast(doc_id % 50 AS string), '/repo', cast(doc_id AS string)) AS repo, concat(
  CASE WHEN doc_id % 2 = 0 THEN concat('See https://github.com/a/b/blob/main/x', cast(doc_id AS string), '.md) and https://github.com/a/b/blob/main/y and https://github.com/a/c/blob/z ') ELSE '' END,
  CASE WHEN doc_id % 3 = 0 THEN '[demo](examples/run.py) then [one](example/a b) ' ELSE '' END, text) AS readme
FROM {documents}
"""

def references(name: str) -> list[str]:
    return re.findall(r"\{(\w+)\}", VIEWS[name].replace("{{", "").replace("}}", ""))


def view_closure(names: list[str]) -> list[str]:
    """Views in dependency order."""
    done: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in done:
            for dep in references(name):
                visit(dep)
            done.append(name)

    for name in names:
        visit(name)
    return done


def repeat_rows(text: str, generator: str) -> str:
    """``<each:n>`` repeats a row for 0..n-1; the generator differs by dialect."""
    return re.sub(r"<each:(\d+)>", lambda m: generator.format(last=int(m.group(1)) - 1, n=m.group(1)), text)


def duck_view(name: str) -> str:
    text = repeat_rows(VIEWS[name], "unnest(range(0, {n}))")
    return text.strip().format(**{n: n for n in TABLES + list(VIEWS)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    inputs = {dep: view(spark, sf_dir, dep) for dep in dict.fromkeys(references(name))}
    text = repeat_rows(VIEWS[name], "explode(sequence(0, {last}))")
    return spark.sql(text, **inputs)
