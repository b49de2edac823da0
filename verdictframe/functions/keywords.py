"""Keyword sets, language tags and labels of instructions and repositories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions.codeblocks import contains_any

# Vocabulary, language indicators in test order, label words.
TECHNICAL_KEYWORDS = [
    "tree", "array", "list", "sort", "search", "graph", "algorithm",
    "recursive", "cache", "dynamic", "binary", "hash", "queue", "stack",
    "react", "component", "state", "hook", "api", "async", "promise",
    "visualization", "chart", "d3", "animation", "3d", "game", "mesh",
    "dataframe", "numpy", "sklearn", "neural", "network", "model",
    "websocket", "event", "listener", "dom", "css", "html",
    "optimization", "performance", "memory", "time", "complexity",
    "loop", "function", "class", "variable", "string", "number",
]
LANGUAGE_INDICATORS = {
    "python": ["python", "pip", "pandas", "numpy", "django", "flask"],
    "javascript": ["javascript", "js", "node", "react", "vue", "npm", "html", "css", "dom"],
    "java": ["java", "maven", "spring"],
    "cpp": ["c++", "cpp", "template"],
}
BROWSER_WORDS = ["html", "css", "react", "dom", "browser"]
REPO_LANGUAGES = {
    "javascript": ["react", "vue", "angular", "svelte", "plotly", "echarts", "mermaid",
                   "cytoscape", "d3", "babylon", "playcanvas"],
    "python": ["python", "numpy", "pandas", "sklearn", "tensorflow", "pytorch"],
    "java": ["java", "libgdx"],
    "cpp": ["cpp", "c++", "godot", "cocos"],
    "go": ["go", "golang"],
    "typescript": ["typescript", "ts"],
}
EASY_WORDS = ["easy", "beginner", "simple"]
HARD_WORDS = ["hard", "complex", "advanced"]
WORD = r"[\p{L}\p{N}_]+"


def keywords(instruction: Column, vocabulary: list[str] = TECHNICAL_KEYWORDS) -> Column:
    """Distinct vocabulary words of the text, whole words only, sorted."""
    words = F.regexp_extract_all(F.lower(instruction), F.lit(WORD), 0)
    return F.array_sort(F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), words))


def _first_listed(text: Column, table: dict[str, list[str]], default: Column) -> Column:
    out = None
    for name, words in table.items():
        test = contains_any(text, words)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def language_of(
    instruction: Column, indicators: dict[str, list[str]] = LANGUAGE_INDICATORS
) -> Column:
    """First language with an indicator anywhere in the text.

    Indicators are substrings, so ``random`` holds ``dom``.
    """
    low = F.lower(instruction)
    default = F.when(contains_any(low, BROWSER_WORDS), "javascript").otherwise("python")
    return _first_listed(low, indicators, default)


def repo_language(repo: Column) -> Column:
    return _first_listed(F.lower(repo), REPO_LANGUAGES, F.lit("general"))


def difficulty(labels: Column) -> Column:
    """Difficulty by the words of all labels together; easy is tested first."""
    low = F.lower(labels)
    return F.when(contains_any(low, EASY_WORDS), "easy").when(
        contains_any(low, HARD_WORDS), "hard"
    ).otherwise("medium")
