"""Lexers of Python and of JavaScript or TypeScript code, each one pass of an alternation of lexemes.

A lexeme is taken where it begins, so a quote in a comment opens no string and an import in a string is no
import. Repeats are possessive: a match never goes back, and long strings need no deep stack. What remains
when comments go and strings keep their quotes only is ``code_only``; what a lexeme holds is read by group.

Not told apart: names in the braces of formatted strings, and templates nested deeper than two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python: a comment, an import call with its module (groups 1, 2), strings with three quotes (3, 4), with one (5, 6).
PYTHON = (
    r"(?s)#[^\n\r]*+"
    r"""|(?<![\w.])(?:importlib\s*+\.\s*+import_module|\w++\s*+\.\s*+__import__)\s*+\(\s*+(?:"([\w.]++)"|'([\w.]++)')"""
    r'''|("")"(?:[^"\\]++|\\.|"(?!""))*+(?:"""|\z)'''
    r"""|('')'(?:[^'\\]++|\\.|'(?!''))*+(?:'''|\z)"""
    r'''|(")(?:[^"\\\n]++|\\.)*+"'''
    r"""|(')(?:[^'\\\n]++|\\.)*+'"""
)
PYTHON_CODE = "$3$4$5$5$6$6"
# JavaScript: comments, the module of an import or export (1) or of a call (2), strings (3, 4), templates (5, 6), regular expressions.
SCRIPT = (
    r"(?s)//[^\n\r]*+|/\*.*?(?:\*/|\z)"
    r"""|(?<![\w.$])(?:import|from)\s*+["']([^"'\n\\]++)["']"""
    r"""|(?<![\w.$])(?:import|require)\s*+\(\s*+["'`]([^"'`\n\\$]++)["'`]"""
    r'''|(")(?:[^"\\\n]++|\\.)*+"'''
    r"""|(')(?:[^'\\\n]++|\\.)*+'"""
    r"|(`)(?:[^`\\$]++|\\.|\$(?!\{)|\$\{(?:[^`{}]++|\{[^{}]*+\}|`(?:[^`\\]++|\\.)*+`)*+\})*+`"
    r"|(`)(?:[^`\\]++|\\.)*+`"
    r"|(?<=[(,=:\[!&|?;]\s{0,8})/(?![/*])(?:[^/\\\n\[]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[a-z]*+"
)
SCRIPT_CODE = "$3$3$4$4$5$5$6$6"


def python_code_only(code: Column) -> Column:
    """Python without comments and without what its strings hold; continued lines are joined."""
    return F.regexp_replace(F.regexp_replace(code, PYTHON, PYTHON_CODE), r"\\\r?\n", " ")


def script_code_only(code: Column) -> Column:
    """JavaScript or TypeScript without comments, regular expressions, modules, and without what its strings hold."""
    return F.regexp_replace(code, SCRIPT, SCRIPT_CODE)


def _named(code: Column, lexer: str, groups: tuple[int, ...]) -> Column:
    return F.filter(F.concat(*[F.regexp_extract_all(code, F.lit(lexer), F.lit(g)) for g in groups]), lambda s: s != "")


def python_import_calls(code: Column) -> Column:
    """Modules named by import calls."""
    return _named(code, PYTHON, (1, 2))


def script_modules(code: Column) -> Column:
    """Modules named by imports, exports and calls of require or import."""
    return _named(code, SCRIPT, (1, 2))


def script_templates(code: Column) -> Column:
    """The template strings."""
    return F.filter(F.regexp_extract_all(code, F.lit(SCRIPT), F.lit(0)), lambda s: s.startswith("`"))
