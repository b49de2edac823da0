"""Verdicts in judge replies: labels, JSON with repair, keywords, XML."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdictframe.functions.codeblocks import contains_any
from verdictframe.functions.predicates import lookup, squeeze

# Verdict patterns, winner names, keyword order, rating levels.
VERDICT_PATTERNS = [r"\[\[([AB<>=]+)\]\]", r"\[([AB<>=]+)\]"]
WINNER_TO_VOTE = {"A": "vote_left", "B": "vote_right", "TIE": "vote_tie", "BOTH_BAD": "vote_both_bad"}
VOTE_NAMES = ["vote_left", "vote_right", "vote_tie", "vote_both_bad"]
DIMENSIONS = ["question_quality", "question_difficulty"]
RATING_LEVELS = ["excellent", "good", "average", "poor", "very poor",
                 "very easy", "easy", "medium", "hard", "very hard"]
STRAY_BACKSLASH = r"""(?<!\\)\\(?!\\|["'/bfnrt])"""


def verdict_label(judgment: Column, patterns: list[str] = VERDICT_PATTERNS) -> Column:
    """Last match of the first pattern that matches, upper-cased; else NULL."""
    text = F.upper(judgment)
    return F.coalesce(*[
        F.try_element_at(F.regexp_extract_all(text, F.lit(p), 1), F.lit(-1)) for p in patterns
    ])


def repaired(reply: Column) -> Column:
    """Reply without fence marks, with the common escape faults undone."""
    text = squeeze(reply)
    text = F.regexp_replace(text, "^```(?:json)?", "")
    text = squeeze(F.regexp_replace(text, "```$", ""))
    text = F.replace(text, F.lit("\\'"), F.lit("'"))
    return F.regexp_replace(text, STRAY_BACKSLASH, r"\\\\")


def first_balanced_object(text: Column) -> Column:
    """From the first ``{`` to the ``}`` that closes it; NULL when none does.

    The text is cut at closing braces and re-joined until the depth is back to
    zero, so nesting of any depth is followed exactly.
    """
    start = F.locate("{", text)
    parts = F.split(F.substring(text, start, F.length(text)), r"\}")
    pieces = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    begin = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("closed"), F.lit("").alias("text")
    )

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.length(part) - F.length(F.replace(part, F.lit("{"), F.lit(""))) - 1
        return F.struct(
            F.when(acc["closed"], acc["depth"]).otherwise(depth).alias("depth"),
            (acc["closed"] | (depth == 0)).alias("closed"),
            F.when(acc["closed"], acc["text"])
            .otherwise(F.concat(acc["text"], part, F.lit("}"))).alias("text"),
        )

    found = F.aggregate(pieces, begin, step)
    return F.when((start > 0) & found["closed"], found["text"])


def in_array(text: Column) -> Column:
    """VARIANT of the text wrapped in an array.

    The parser ignores what follows a JSON value; inside an array such a tail is a
    syntax error or a second element, so :func:`only_value` can be strict.
    """
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def only_value(wrapped: Column) -> Column:
    second = F.try_variant_get(wrapped, "$[1]", "variant")
    return F.when(second.isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def overall_vote(json: Column) -> Column:
    """Vote by the overall winner, given as an object or as a bare string."""
    winner = F.coalesce(
        F.try_variant_get(json, "$.Overall.winner", "string"),
        F.when(
            F.schema_of_variant(F.try_variant_get(json, "$.Overall", "variant")) == "STRING",
            F.try_variant_get(json, "$.Overall", "string"),
        ),
    )
    return F.coalesce(lookup(F.upper(winner), WINNER_TO_VOTE), F.lit("error"))


def keyword_vote(reply: Column) -> Column:
    """Vote by literal names, then by wording; ``error`` when nothing fits."""
    low = F.lower(reply)
    rules = [(low.contains(name), name) for name in VOTE_NAMES]
    rules += [
        (low.contains("model a") & low.contains("better"), "vote_left"),
        (low.contains("model b") & low.contains("better"), "vote_right"),
        (contains_any(low, ["equal", "equivalent"]), "vote_tie"),
        (contains_any(low, ["both_bad", "both bad", "neither"]), "vote_both_bad"),
    ]
    first = F.when(rules[0][0], rules[0][1])
    return reduce(lambda c, r: c.when(*r), rules[1:], first).otherwise("error")


def short_vote(reply: Column) -> Column:
    """Vote of a one-word reply, NULL when it is not one."""
    text = squeeze(F.upper(reply))
    return (
        F.when((text == "A") | text.contains("SOLUTION A"), "vote_left")
        .when((text == "B") | text.contains("SOLUTION B"), "vote_right")
        .when(text == "TIE", "vote_tie")
        .when(text == "BOTH_BAD", "vote_both_bad")
    )


# ---------------------------------------------------------------- evaluations

def evaluation(response: Column) -> Column:
    """(status, verdict, score) of the outermost ``{...}`` of an evaluation.

    Missing fields default to success, FAIL and 0; no valid object is an error.
    """
    json = only_value(in_array(F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))))

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.try_variant_get(json, f"$.{name}", "string"), F.lit(default))

    score = F.coalesce(F.try_variant_get(json, "$.total_score", "double"), F.lit(0.0))
    return F.struct(
        F.when(json.isNull(), F.lit("error")).otherwise(field("status", "success")).alias("status"),
        F.when(json.isNull(), F.lit("FAIL")).otherwise(field("verdict", "FAIL")).alias("verdict"),
        F.when(json.isNull(), F.lit(0.0)).otherwise(score).alias("score"),
    )


# ---------------------------------------------------------------- assessments

def assessment(response: Column) -> Column:
    """Rating and reasoning per dimension; NULL when no dimension is rated."""
    body = F.regexp_extract(response, r"(?s)<response>.*</response>", 0)

    def text_of(part: Column, tag: str) -> Column:
        found = F.regexp_extract(part, f"(?s)<{tag}>(.*?)</{tag}>", 1)
        return F.nullif(squeeze(found), F.lit(""))

    dims = []
    for name in DIMENSIONS:
        part = F.regexp_extract(body, f"(?s)<{name}>(.*?)</{name}>", 1)
        rating = text_of(part, "rating")
        dims.append(
            F.when(
                rating.isNotNull(),
                F.struct(rating.alias("rating"), text_of(part, "reasoning").alias("reasoning")),
            ).alias(name)
        )
    rated = F.lit(False)
    for d in dims:
        rated = rated | d.isNotNull()
    return F.when(rated, F.struct(*dims))


def preview(text: Column, size: int, always: bool = False) -> Column:
    """First ``size`` characters and an ellipsis, when longer or always."""
    cut = F.concat(F.substring(text, 1, size), F.lit("..."))
    return cut if always else F.when(F.length(text) > size, cut).otherwise(text)


def answer_after_thinking(text: Column) -> Column:
    """Text after the first ``</think>``, empty without one."""
    return squeeze(F.regexp_extract(text, r"(?s)</think>(.*)", 1))
