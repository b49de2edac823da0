"""Clean-up of generated text: questions, solutions, enriched prompts, readmes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions.predicates import squeeze

# Artefact patterns, phrases, markers and limits.
LINE_ARTEFACTS = [
    r"^-\s*Do\s+NOT\s+.*?\n",
    r"^-\s*Do\s+not\s+.*?\n",
    r"^-\s*Match\s+.*?\n",
    r"^-\s*Ensure\s+.*?\n",
    r"^-\s*Use\s+.*?\n",
    r"^-\s*.*?\n",
    r"^Output\s+only\s+.*?\n",
    r"^\*\*Output\s+.*?\*\*\n",
    r"^<\|.*?\|>.*?\n",
]
QUESTION_NUMBER = r"(?i)^\[?Question\s*\d*\]?:?\s*"
HEADING_MARK = r"^#+\s*"
BLANK_LINES = r"\n\s*\n+"
META_PHRASES = [
    "you must not include", "wrap the entire", "do not include", "the code", "should be",
    "self-contained", "executable", "ensure the code", "provide only", "output only", "note:",
    "requirements:", "instructions:", "format as", "only the code", "start with", "make sure",
    "include only", "this solution", "the solution", "valid json", "json array",
    "no explanations", "no text", "no markdown", "no extra", "no other",
]
CODE_MARKS = ["import ", "def ", "class ", "<", "function ", "const ", "let ", "var ", "{"]


def _either(words: list[str]) -> str:
    """Alternation; a trailing blank needs something after it on the line."""
    return "|".join(
        re.escape(w.rstrip()) + (r" .*\S" if w.endswith(" ") else "") for w in words
    )


# Start of the first line with a code mark and without any instruction phrase.
CODE_LINE = rf"(?dim)^(?!.*(?:{_either(META_PHRASES)}))(?=.*(?:{_either(CODE_MARKS)}))"
RULE = "=" * 80
ENRICHMENT_MARKERS = [
    "---\n\n**Related Real-World Examples from GitHub:**",
    RULE + "\n📚 **HELPFUL RESOURCES & REFERENCES**",
    "---\n\n**ENRICHMENT CONTEXT:**",
    "### 💬 Stack Overflow Q&A",
    "### 📖 Official Documentation",
]
PROMPT_LIMIT, RESOURCE_LIMIT = 1500, 800
EXAMPLE_LINK_PATTERNS = [
    r"(https://github\.com/[^/]+/[^/]+/blob/[^\s)]+)",
    r"\[.+?\]\((examples?/[^\)]+)\)",
]
EXAMPLE_FOLDERS = ["tree/main/examples", "tree/main/demo", "tree/main/samples"]


def clean_question(text: Column) -> Column:
    """Question text without generator artefacts, list lines and numbering."""
    # (?d): only \n ends a line, so carriage returns stay inside lines.
    out = reduce(
        lambda c, p: F.regexp_replace(c, f"(?dim){p}", ""), LINE_ARTEFACTS, squeeze(text)
    )
    out = F.regexp_replace(out, QUESTION_NUMBER, "")
    out = F.regexp_replace(out, HEADING_MARK, "")
    return squeeze(F.regexp_replace(out, BLANK_LINES, "\n"))


def clean_solution(text: Column) -> Column:
    """Solution from its first code-looking line on, code fences removed.

    Lines with an instruction phrase never start the code; once it has started
    every line stays.
    """
    first = F.regexp_instr(text, F.lit(CODE_LINE))
    kept = F.when(first > 0, F.substring(text, first, F.length(text))).otherwise("")
    body = squeeze(kept)
    body = squeeze(F.regexp_replace(body, r"^(?:```[^\n]*\n\s*)+", ""))
    return F.regexp_replace(body, r"(?:\s*```)+$", "")


def test_cases(text: Column) -> Column:
    """JSON array from the first ``[`` to the last ``]`` as VARIANT, else NULL."""
    return F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\[.*\]", 0), F.lit("")))


def without_enrichment(text: Column) -> Column:
    """Text before the first listed enrichment marker that occurs, trimmed."""
    out = None
    for marker in ENRICHMENT_MARKERS:
        kept = squeeze(F.substring_index(text, marker, 1))
        test = text.contains(marker)
        out = F.when(test, kept) if out is None else out.when(test, kept)
    return out.otherwise(text)


def truncated_prompt(text: Column) -> Column:
    """Long enriched prompts keep the task and the start of the resources."""
    parts = F.split(text, RULE)
    cut = F.when(
        F.size(parts) >= 2,
        F.concat(F.get(parts, 0), F.lit("\n\n"), F.substring(F.get(parts, 1), 1, RESOURCE_LIMIT)),
    ).otherwise(F.substring(text, 1, PROMPT_LIMIT))
    return F.when(F.length(text) > PROMPT_LIMIT, cut).otherwise(text)


def example_links(readme: Column, repo: Column, limit: int = 3) -> Column:
    """Example links: two per pattern, then the usual folders, up to ``limit``."""
    found = [F.slice(F.regexp_extract_all(readme, F.lit(p), 1), 1, 2) for p in EXAMPLE_LINK_PATTERNS]
    usual = F.array(*[
        F.concat(F.lit("https://github.com/"), repo, F.lit(f"/{folder}")) for folder in EXAMPLE_FOLDERS
    ])
    return F.slice(F.concat(*found, usual), 1, limit)
