"""Lexers against the parser of the standard library and against a scanner character by character."""

import ast
import random

from pyspark.sql import functions as F

from verdictframe.functions import codeblocks as cb
from verdictframe.functions import lexers

QUOTES = ['"', "'", '"""', "'''"]


def column(spark, make, values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, c string").repartition(4)
    return [r["v"] for r in rows.select("k", make(F.col("c")).alias("v")).orderBy("k").collect()]


def python_program(rng):
    lines = []
    for _ in range(rng.randint(1, 12)):
        quote = rng.choice(QUOTES)
        inner = rng.choice(["import fake", "# no", "from fake.sub import x", "it", "\\" + quote[0], "a # b", "x = 1; import fake", ""])
        if len(quote) == 3:
            inner = inner + "\n" + rng.choice(["import fake_two", "'", '"', "plain"]) + "\n"
        lines.append(rng.choice([
            f"import pkg{rng.randint(0, 9)}, os.path", f"from lib{rng.randint(0, 9)}.sub import (a,\n  b)", "from . import local",
            f"x = {rng.choice(['', 'r', 'f', 'b'])}{quote}{inner}{quote}" if "\\" not in inner else f"x = {quote}{inner}{quote}",
            f"y = 1  # import fake; {rng.choice(QUOTES)}", f"if x: import late{rng.randint(0, 9)}", f"y = 2; import semi{rng.randint(0, 9)}",
            "import sys, \\\n  cont1", "z = importlib.import_module('dyn.amic')", "def f():\n    import inner1",
        ]))
    return "\n".join(lines)


def imported(code):
    found = set()
    for node in ast.walk(ast.parse(code)):
        if isinstance(node, ast.Import):
            found |= {n.name.split(".")[0] for n in node.names}
        elif isinstance(node, ast.ImportFrom) and not node.level:
            found.add(node.module.split(".")[0])
        elif isinstance(node, ast.Call) and getattr(node.func, "attr", "") == "import_module":
            found.add(node.args[0].value.split(".")[0])
    return found - set(cb.STDLIB)


def valid(code):
    try:
        ast.parse(code)
        return True
    except (SyntaxError, ValueError):
        return False


def test_python_imports_equal_the_parser(spark):
    rng = random.Random(4)
    programs = [p for p in (python_program(rng) for _ in range(500)) if valid(p)]
    assert len(programs) > 300
    for program, got in zip(programs, column(spark, cb.python_imports, programs)):
        assert set(got) == imported(program), program


def scanned(code):
    """Code without comments and without what strings and templates hold."""
    out, k = [], 0
    while k < len(code):
        two = code[k : k + 2]
        if two == "//":
            while k < len(code) and code[k] not in "\r\n":
                k += 1
        elif two == "/*":
            stop = code.find("*/", k + 2)
            k = len(code) if stop < 0 else stop + 2
        elif code[k] in "\"'`":
            quote, stop = code[k], k + 1
            while stop < len(code) and code[stop] != quote and not (quote != "`" and code[stop] == "\n"):
                stop += 2 if code[stop] == "\\" else 1
            if stop < len(code) and code[stop] == quote:
                out.append(quote * 2)
                k = stop + 1
            else:
                out.append(code[k])
                k += 1
        else:
            out.append(code[k])
            k += 1
    return "".join(out)


def script_program(rng):
    pieces = ["const a = b;", "f(x)", "// it's", "/* 'x */", "\n", " ", "'text'", '"te\\"xt"', "`multi\nline`", "don't", "x / y", "{ }", '"open', "'a\\'b'", "`a 'b' \"c\"`"]
    return "".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 14)))


def test_script_lexer_equals_a_scanner(spark):
    rng = random.Random(5)
    programs = [script_program(rng) for _ in range(600)]
    for program, got in zip(programs, column(spark, lexers.script_code_only, programs)):
        assert got == scanned(program), program


def test_script_modules(spark):
    code = [
        """import a from 'react-dom/client'; import './x'; const b = require("@s/p/q"); export * from "d3"; import("lazy"); import(`tick/x`)""",
        """// import "no"\nconst s = "import 'no'"; const t = `require("no")`; /* from "no" */ obj.require("no"); import x from "https://cdn.dev/y"; import z from "@/alias" """,
        """const t = `a ${ f(`inner "x`) } require("no") b`; const u = require("socket.io"); const r = /["'`]/g; import "after" """,
        "x" * 200_000 + ' import "far"', '"' + "a" * 100_000 + '"; import "long"', "`" + "b\n" * 60_000 + "`; import 'longer'", "", None,
    ]
    got = [sorted(g) if g is not None else g for g in column(spark, cb.npm_imports, code)]
    assert got == [["@s/p", "d3", "lazy", "react-dom", "tick"], [], ["after", "socket.io"], ["far"], ["long"], ["longer"], [], None]


def test_long_python_needs_no_deep_stack(spark):
    code = ['"""' + "import no\n" * 50_000 + '"""\nimport yes', "# " + "x" * 300_000 + "\nimport yes", "x = '" + "\\'" * 100_000 + "'\nimport yes"]
    assert column(spark, cb.python_imports, code) == [["yes"]] * 3


def test_types_and_names_in_comments_and_strings_do_not_count(spark):
    scripts = [
        "// const x: number = 1", 'const s = "interface Row { }"', "const t = `enum Kind { A }`", "const x: number = 1", "interface Row { id: 1 }",
        "const [v] = useState<string>('')", "@Component({})\nexport class A { }", "declare module 'x'", "const v = a ? b : c;",
    ]
    assert column(spark, cb.script_language, scripts) == ["javascript"] * 3 + ["typescript"] * 5 + ["javascript"]
    programs = ["note = 'st.title'", "# gr.Blocks", "x.st = 1", "import numpy as st", "f(st=1)", "st.title('x')", "import gradio as gr\ngr.Blocks()"]
    got = column(spark, lambda c: cb.python_environment(c, cb.python_imports(c)), programs)
    assert got == ["Python Runner"] * 5 + ["Streamlit", "Gradio"]
    views = ["const t = `<li v-for='x in y' @click='go'></li>`", 'const t = "=> <div>"', "const el = <div>x</div>", "const t = `plain`"]
    got = column(spark, lambda c: cb.script_environment(c, cb.npm_imports(c)), views)
    assert got == ["Vue", "Javascript Runner", "React", "Javascript Runner"]


def test_the_standard_library_does_not_change_with_the_version():
    assert {"os", "distutils", "imp", "asyncore", "telnetlib", "tomllib", "__future__"} <= set(cb.STDLIB)
    assert not {"numpy", "annotationlib", "compression"} & set(cb.STDLIB)
