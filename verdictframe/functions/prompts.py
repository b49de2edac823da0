"""Prompt texts assembled from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Section marks, truncation notes and limits.
RESPONSE = ("<|The Start of Model Response|>\n", "\n<|The End of Model Response|>")
RESULTS = ("<|The Start of Execution Results|>\n", "\n<|The End of Execution Results|>")
ERRORS = ("<|The Start of Execution Errors and Warnings|>\n",
          "\n<|The End of Execution Errors and Warnings|>")
CODE = ("<|The Start of Code|>\n", "\n<|The End of Code|>")
TRUNCATED, CODE_TRUNCATED = "\n...[Truncated]", "\n...[Code truncated]"
OUTPUT_LIMIT = 1000
REWARD_CODE_LIMIT, REWARD_INSTRUCTION_LIMIT, REWARD_OUTPUT_LIMIT = 20000, 5000, 3000
NO_OUTPUT = "[No code output]"
NO_RESPONSE = "[No response found]"
JUDGE_TEMPLATE = (
    "<|The Start of User Question|>\n{QUESTION}\n<|The End of User Question|>\n\n"
    "<|The Start of Assistant A's Answer|>\n{ANSWER_A}{SCREENSHOT_A_SECTION}{VISUAL_A_SECTION}"
    "<|The End of Assistant A's Answer|>\n\n"
    "<|The Start of Assistant B's Answer|>\n{ANSWER_B}{SCREENSHOT_B_SECTION}{VISUAL_B_SECTION}"
    "<|The End of Assistant B's Answer|>"
)
EVALUATION_LIMIT, EVALUATION_OUTPUT_LIMIT = 2000, 500


def capped(text: Column, limit: int, note: str) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(note))
    ).otherwise(text)


def _section(marks: tuple[str, str], text: Column) -> Column:
    """Marked section, NULL for an absent or empty text."""
    return F.when(
        F.coalesce(text, F.lit("")) != "", F.concat(F.lit(marks[0]), text, F.lit(marks[1]))
    )


def complete_answer(
    response: Column, stdout: Column, stderr: Column, has_visuals: Column,
    with_execution: bool = True,
) -> Column:
    """Response plus run output; errors only without any output or picture."""
    parts = [_section(RESPONSE, response)]
    if with_execution:
        silent = (F.coalesce(stdout, F.lit("")) == "") & ~F.coalesce(has_visuals, F.lit(False))
        parts.append(_section(RESULTS, capped(stdout, OUTPUT_LIMIT, TRUNCATED)))
        parts.append(F.when(silent, _section(ERRORS, capped(stderr, OUTPUT_LIMIT, TRUNCATED))))
    return F.concat_ws("\n\n", *parts)


def reward_answer(code: Column, output: Column, with_output: bool = True) -> Column:
    """Code and output of one side of a reward record, with their limits."""
    parts = [_section(CODE, capped(code, REWARD_CODE_LIMIT, CODE_TRUNCATED))]
    if with_output:
        parts.append(_section(RESULTS, capped(output, REWARD_OUTPUT_LIMIT, TRUNCATED)))
    return F.coalesce(F.nullif(F.concat_ws("\n\n", *parts), F.lit("")), F.lit(NO_RESPONSE))


def screenshot_section(present: Column, label: str, kind: str = "UI Screenshot") -> Column:
    """Marked placeholder for a picture, empty without one."""
    text = (
        f"\n<|The Start of Assistant {label}'s {kind}|>\n{{SCREENSHOT_{label}}}\n"
        f"<|The End of Assistant {label}'s {kind}|>"
    )
    return F.when(F.coalesce(present, F.lit(False)), F.lit(text)).otherwise(F.lit(""))


def fill(template: str | Column, values: dict[str, Column]) -> Column:
    """Replace ``{NAME}`` marks in the given order."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def judge_prompt(
    question: Column, answer_a: Column, answer_b: Column, picture_a: Column, picture_b: Column,
    template: str = JUDGE_TEMPLATE, kind: str = "UI Screenshot",
) -> Column:
    def body(text: Column) -> Column:
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_OUTPUT))

    return fill(template, {
        "QUESTION": question,
        "ANSWER_A": body(answer_a),
        "ANSWER_B": body(answer_b),
        "SCREENSHOT_A_SECTION": screenshot_section(picture_a, "A", kind),
        "SCREENSHOT_B_SECTION": screenshot_section(picture_b, "B", kind),
        "VISUAL_A_SECTION": F.lit(""),
        "VISUAL_B_SECTION": F.lit(""),
    })


def evaluation_prompt(template: str, question: Column, code: Column, stdout: Column, stderr: Column) -> Column:
    """Single-answer evaluation prompt with its own shorter limits."""

    def shown(text: Column, empty: str) -> Column:
        short = F.substring(F.coalesce(text, F.lit("")), 1, EVALUATION_OUTPUT_LIMIT)
        return F.when(short == "", F.lit(empty)).otherwise(short)

    return fill(template, {
        "QUESTION": F.substring(question, 1, EVALUATION_LIMIT),
        "CODE": F.substring(code, 1, EVALUATION_LIMIT),
        "STDOUT": shown(stdout, "(no output)"),
        "STDERR": shown(stderr, "(no errors)"),
    })
