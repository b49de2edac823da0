"""Text functions on hand-made cases."""

import math
import re

import pytest
from pyspark.sql import functions as F

from verdictframe.functions import cleanup, codeblocks as cb, quality, records, verdicts
from verdictframe.functions.predicates import squeeze, vote_of, winner_of
from verdictframe.operators import agreement, codejobs
from verdictframe.operators.quality import voted_replies


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_squeeze_matches_strip(spark):
    values = [" a b \t", " x　", "\x1cq\x85", "", "\n\r\n"]
    assert apply(spark, squeeze, values) == [v.strip() for v in values]


def test_vote_vocabularies(spark):
    raw = ["vote_model_A", "vote_model_B", "vote_left", "vote_both_bad", "other", "", None]
    assert apply(spark, vote_of, raw) == ["vote_left", "vote_right", "vote_left", "vote_both_bad", None, None, None]
    assert apply(spark, lambda c: vote_of(c, False), ["vote_left", "vote_tie"]) == [None, "vote_tie"]
    assert apply(spark, winner_of, ["left", "both_bad", "x"]) == ["model_a", "tie (bothbad)", None]


def plain_main_block(message):
    found = re.findall(r"```([\w\+\#\-\.]*)[ \t]*\r?\n?(.*?)```", message, re.DOTALL)
    if not found:
        return None
    best = None
    for lang, code in found:
        code, lang = code.strip(), lang.lower()
        if lang not in cb.LOW_PRIORITY and len(code) > (len(best[1]) if best else 0):
            best = (lang, code)
    if best is None:
        lang, code = max(found, key=lambda b: len(b[1]))
        best = (lang.lower(), code.strip())
    return best


def test_main_block_choices(spark):
    cases = [
        "no block", "```\nplain\n```", "```python\nx=1\n``` ```js\nlonger code\n```",
        "```bash\nmuch longer than the rest\n```\n```py\na\n```", "```sh\naa\n``` ```\nbbbb\n```",
        "```python\n``` ```\nz\n```", "```Python3  \r\nq\n```", "```py\nab\n``` ```js\ncd\n```",
        "text ``` unclosed", "```c++\nint x;\n``` tail ```",
    ]
    rows = apply(spark, lambda c: cb.main_block(cb.fenced_blocks(c)), cases)
    got = [(r["lang"], r["code"]) if r else None for r in rows]
    assert got == [plain_main_block(c) for c in cases]


@pytest.mark.parametrize("lang,code,environment", [
    ("python", "import gradio as gr\ngr.x()", "Gradio"), ("py", "st.write(1); gr.x()", "Streamlit"),
    ("python", "import gradio", "Gradio"), ("json", "{}", "Javascript Runner"), ("c++", "int x;", "C++ Runner"),
    ("c", "int x;", "C Runner"), ("java", "x", "Java Runner"), ("javascript", "x", "Javascript Runner"),
    ("text", "<html></html>", "HTML"), ("js", "<!DOCTYPE html><head></head>", "HTML"), ("xml", "<svg/>", "HTML"),
    ("ts", "import x from 'next/router'", "React"), ("html", "<p>x</p>", "Javascript Runner"),
    ("js", "const a = defineComponent({})", "Vue"), ("cobol", "x", None), ("rust", "x", "Rust Runner"),
    ("jsx", "return <App/>;", "React"), ("mmd", "graph", "Mermaid"), ("golang", "x", "Golang Runner"),
])
def test_routes(spark, lang, code, environment):
    df = spark.createDataFrame([(1, f"```{lang}\n{code}\n```")], "uid int, answer string")
    assert codejobs.extract_code(df).first()["environment"] == environment


def test_python_imports(spark):
    code = "import os, numpy.linalg as la, pandas\nfrom torch.nn import x\nfrom . import y\n  import scipy\n# import no"
    assert sorted(apply(spark, cb.python_imports, [code])[0]) == ["numpy", "pandas", "scipy", "torch"]


def test_npm_imports(spark):
    code = """import a from 'react-dom/client'; import './x'; const b = require("@s/p/q"); export * from "d3"; import("lazy")"""
    assert sorted(apply(spark, cb.npm_imports, [code])[0]) == ["@s/p", "d3", "lazy", "react-dom"]


def test_install_lines(spark):
    code = "# pip install no\npip install -U 'a b==1' c>=2 c>=2\npython -m pip install d\nnpm i -D e @x/y@1 e\nyarn add f\nnpm install"
    df = spark.createDataFrame([(code,)], "c string")
    python, npm = df.select(*cb.install_packages(F.col("c"))).first()
    assert python == ["a b==1", "c>=2", "d"] and npm == ["e", "@x/y@1", "f"]


def test_typescript_label(spark):
    cases = ["let x = 1", "interface A { b: string }", "type T = string", "const f = (a: number) => a", "enum E { A }"]
    assert apply(spark, cb.script_language, cases) == ["javascript"] + ["typescript"] * 4


def test_placeholders_clamp(spark):
    code = "/api/placeholder/0/5 /api/placeholder/20000/300 /api/placeholder/640/480 /api/placeholder/" + "9" * 60 + "/7"
    got = [(p["width"], p["height"]) for p in apply(spark, cb.placeholders, [code])[0]]
    assert got == [(100, 100), (1000, 300), (640, 480), (1000, 7)]


def test_clean_solution(spark):
    cases = [
        "Note: the code\n\nHere:\nimport os\nnote: stays\n```", "```python\ndef f(): pass\n```", "prose only\nnothing",
        "```js\nlet x = 1\n```\n```", "make sure import works\nvar y = 1", "import ", "<a>",
    ]
    assert apply(spark, cleanup.clean_solution, cases) == [
        "import os\nnote: stays", "def f(): pass", "", "let x = 1", "var y = 1", "", "<a>",
    ]


def test_clean_question(spark):
    cases = ["- Do NOT x\n- Use y\n[Question 2]: Real\n\n \n\nmore", "## Head\ntext", "<|x|> y\nok", "- a\n"]
    assert apply(spark, cleanup.clean_question, cases) == ["Real\nmore", "Head\ntext", "ok", "- a"]


def test_verdict_labels(spark):
    cases = ["[[A>B]] [[B>>A]]", "[a=b]", "[[]] [A>B]", "[[x]]", "", "[[A<B]]\n[B>A]"]
    assert apply(spark, verdicts.verdict_label, cases) == ["B>>A", "A=B", "A>B", None, None, "A<B"]


def test_reply_votes(spark):
    cases = [
        ('{"Overall": {"winner": "a"}}', "vote_left"), ('```json\n{"Overall": "TIE"}\n```', "vote_tie"),
        ('x {"Overall": {"winner": "B", "y": {"z": "}"}}} {', "error"),
        ('pre {"Overall": {"winner": "B", "d": {"e": {}}}} post {"q"', "vote_right"),
        ('{"Overall": {"winner": "A"}} trailing', "error"), ("[1, 2]", "error"), ("", "error"), (None, "error"),
        ('{"Overall": {"winner": "A", "r": "\\alpha"}}', "vote_left"), ("model b looks better", "vote_right"),
        ('{"Overall": 3}', "error"), ("both bad", "vote_both_bad"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, reply string")
    got = [r["vote"] for r in voted_replies(df, "reply").orderBy("i").collect()]
    assert got == [c[1] for c in cases]


def test_evaluation_defaults(spark):
    rows = apply(spark, verdicts.evaluation, ['a {"verdict": "PASS", "total_score": 9.5} b', "{}", "none", "{bad}"])
    assert [(r["status"], r["verdict"], r["score"]) for r in rows] == [
        ("success", "PASS", 9.5), ("success", "FAIL", 0.0), ("error", "FAIL", 0.0), ("error", "FAIL", 0.0)]


def plain_quality(text):
    if not text or text.startswith("ERROR") or not text.strip():
        return False, 0.0
    code = 0.3 * ("def " in text or "class " in text) + 0.2 * ("import " in text) + 0.2 * ("```" in text or "    " in text)
    if code == 0:
        return False, 0.1
    score = 0.2 + min(code, 0.3)
    score += 0.2 if all(text.count(a) == text.count(b) for a, b in ("()", "[]", "{}")) else 0.05
    score += 0.15 if '"""' in text or "'''" in text or "#" in text else 0.05
    score += 0.1
    return score >= 0.6, min(score, 1.0)


def test_answer_quality(spark):
    cases = ["", None, "  \n", "ERROR x", "plain", "def f(: #", "import x (", "class A: pass", "    x", "def f():\n    '''d'''"]
    rows = apply(spark, quality.answer_quality, cases)
    for row, text in zip(rows, cases):
        passed, score = plain_quality(text)
        assert row["passed"] == passed and row["score"] == pytest.approx(score)


def test_latest_round_by_text_and_number(spark):
    logs = "map<string,struct<sandbox_state:struct<sandbox_output:string,screenshot_base64:string>>>"
    value = [{"9": (("nine", ""),), "10": (("ten", "p"),)}, {"1": ((None, None),)}, None]
    assert [r["output"] for r in apply(spark, records.latest_execution, value, logs)] == ["nine", "", ""]
    numeric = apply(spark, lambda c: records.latest_execution(c, True), value, logs)
    assert [r["output"] for r in numeric] == ["ten", "", ""]


def test_dependency_rows(spark):
    cases = [[], [["npm", "", "x"]], [["python", "a", "1"]], [["npm", "b", "@2"], ["ruby", "c", ""]], [["npm"]]]
    assert apply(spark, cb.dependency_problem, cases, "array<array<string>>") == [
        "", "", "Invalid Python version format for a: 1", "Invalid dependency type: ruby",
        "Each dependency must have type, package and version fields"]


def plain_metrics(pairs, labels):
    n = len(pairs)
    tp = {x: sum(t == g == x for t, g in pairs) for x in labels}
    t = {x: sum(a == x for a, _ in pairs) for x in labels}
    p = {x: sum(b == x for _, b in pairs) for x in labels}
    f1 = [2 * tp[x] / (t[x] + p[x]) if t[x] + p[x] else 0.0 for x in labels]
    hits = sum(a == b for a, b in pairs)
    pe = sum(t[x] * p[x] for x in labels) / n**2
    den = math.sqrt((n * n - sum(v * v for v in p.values())) * (n * n - sum(v * v for v in t.values())))
    return (hits / n, sum(f1) / len(labels), None if pe == 1 else (hits / n - pe) / (1 - pe),
            (hits * n - sum(t[x] * p[x] for x in labels)) / den if den else 0.0)


@pytest.mark.parametrize("pairs", [
    [("vote_left", "vote_left")] * 3 + [("vote_right", "vote_tie"), ("vote_tie", "vote_tie"), ("vote_left", "vote_right")],
    [("vote_left", "vote_left")] * 4, [("vote_left", "vote_right")] * 2,
])
def test_metrics_match_formulas(spark, pairs):
    df = spark.createDataFrame([("s", *p) for p in pairs], "k string, human_vote string, judge_vote string")
    row = agreement.metrics(agreement.confusion_cells(df, ["k"]), ["k"]).first()
    want = plain_metrics(pairs, ["vote_left", "vote_right", "vote_tie", "vote_both_bad"])
    got = (row["accuracy"], row["macro_f1"], row["cohen_kappa"], row["matthews_corrcoef"])
    assert got == pytest.approx(want)
