"""Answer quality score by structure, balance and documentation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions.codeblocks import contains_any
from verdictframe.functions.predicates import squeeze

# Weights and the pass mark.
CONTENT, STRUCTURE_CAP, PASS_MARK = 0.2, 0.3, 0.6


def _balanced(text: Column, opening: str, closing: str) -> Column:
    def count(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    return count(opening) == count(closing)


def answer_quality(text: Column) -> Column:
    """(passed, reason, issues, score, failed_run) of one answer.

    Errors and empty answers score 0, answers without any code structure 0.1.
    """
    has_unit = contains_any(text, ["def ", "class "])
    has_import = text.contains("import ")
    has_block = contains_any(text, ["```", "    "])
    structure = (
        F.when(has_unit, 0.3).otherwise(0.0)
        + F.when(has_import, 0.2).otherwise(0.0)
        + F.when(has_block, 0.2).otherwise(0.0)
    )
    balanced = _balanced(text, "(", ")") & _balanced(text, "[", "]") & _balanced(text, "{", "}")
    documented = contains_any(text, ['"""', "'''", "#"])
    score = (
        F.lit(CONTENT)
        + F.least(structure, F.lit(STRUCTURE_CAP))
        + F.when(balanced, 0.2).otherwise(0.05)
        + F.when(documented, 0.15).otherwise(0.05)
        + F.lit(0.1)
    )
    issues = F.array_join(
        F.array_compact(F.array(
            F.when(~balanced, "Unbalanced brackets/parentheses/braces"),
            F.when(~documented, "No documentation/comments"),
        )),
        "; ",
    )
    error = text.isNull() | (text == "") | text.startswith("ERROR")
    empty = ~error & (squeeze(text) == "")
    bare = ~error & ~empty & (structure == 0)
    graded = F.least(score, F.lit(1.0))

    def row(passed: Column, reason: Column, detail: Column, value: Column) -> Column:
        return F.struct(
            passed.alias("passed"), reason.alias("reason"), detail.alias("issues"),
            value.alias("score"),
            F.coalesce(text.startswith("ERROR"), F.lit(False)).alias("failed_run"),
        )

    no, zero = F.lit(False), F.lit(0.0)
    return (
        F.when(error, row(no, F.lit("Execution error"), F.lit("Execution error"), zero))
        .when(empty, row(no, F.lit("Empty answer"), F.lit("Empty answer"), zero))
        .when(bare, row(no, F.lit("No valid code structure"), F.lit("No valid code structure"), F.lit(0.1)))
        .otherwise(row(
            score >= PASS_MARK,
            F.when(score >= PASS_MARK, "Passed").otherwise("Below threshold"),
            F.when(issues == "", "All checks passed").otherwise(issues),
            graded,
        ))
    )
