"""Fields of nested records: sandbox logs, messages, ids, embedded pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions.predicates import present

# Patterns of pictures and pages in program output.
VISUAL_PATTERNS = [
    ("png", r"data:image/png;base64,([A-Za-z0-9+/=]+)", 1),
    ("jpeg", r"data:image/jpeg;base64,([A-Za-z0-9+/=]+)", 1),
    ("svg", r"(?is)<svg[^>]*>.*?</svg>", 0),
    ("html", r"(?is)<!DOCTYPE html>.*?</html>|<html[^>]*>.*?</html>", 0),
]


def latest_execution(logs: Column, numeric: bool = False) -> Column:
    """(output, screenshot) of the latest round that has either.

    Rounds compare as strings ('9' after '10'); ``numeric`` compares numbers.
    """
    def rank(entry: Column) -> Column:
        key = entry["key"].cast("int") if numeric else entry["key"]
        state = entry["value"]["sandbox_state"]
        return F.struct(
            key.alias("round"),
            F.coalesce(state["sandbox_output"], F.lit("")).alias("output"),
            F.coalesce(state["screenshot_base64"], F.lit("")).alias("screenshot"),
        )

    rounds = F.transform(F.map_entries(logs), rank)
    useful = F.filter(rounds, lambda r: (r["output"] != "") | (r["screenshot"] != ""))
    # Compare the round alone: picking the maximum of the whole struct would do,
    # as rounds are unique map keys.
    best = F.array_max(useful)
    return F.struct(
        F.coalesce(best["output"], F.lit("")).alias("output"),
        F.coalesce(best["screenshot"], F.lit("")).alias("screenshot"),
    )


def last_message(messages: Column) -> Column:
    """Last entry of the last message."""
    return F.try_element_at(F.try_element_at(messages, F.lit(-1)), F.lit(-1))


def flatten_reward_record(records: DataFrame) -> DataFrame:
    """Both sides' code, output and screenshot as flat columns."""
    columns = ["chat_session_id", "instruction"]
    out = records
    for side in ("A", "B"):
        state, low = f"states.model_{side}", side.lower()
        run = latest_execution(F.col(f"{state}.sandbox_logs_by_round"))
        out = out.withColumn(f"_run_{low}", run)
        columns += [
            F.coalesce(f"model_{side}", F.lit("unknown")).alias(f"model_{low}"),
            last_message(F.col(f"{state}.messages")).alias(f"code_{low}"),
            F.col(f"_run_{low}.output").alias(f"output_{low}"),
            F.col(f"_run_{low}.screenshot").alias(f"screenshot_{low}"),
        ]
    return out.select(*columns)


def record_id(session: Column, instruction: Column, model_a: Column, model_b: Column) -> Column:
    """Session id, else 16 hex digits of the md5 of instruction and models."""
    parts = [F.coalesce(c, F.lit("")) for c in (instruction, model_a, model_b)]
    return F.when(present(session), session).otherwise(
        F.substring(F.md5(F.concat_ws("_", *parts)), 1, 16)
    )


def embedded_visuals(stdout: Column) -> Column:
    """ARRAY of (type, data) for pictures and pages inside program output."""

    def typed(kind: str, pattern: str, group: int) -> Column:
        matches = F.regexp_extract_all(stdout, F.lit(pattern), group)
        return F.transform(
            matches, lambda m: F.struct(F.lit(kind).alias("type"), m.alias("data"))
        )

    return F.concat(*[typed(*row) for row in VISUAL_PATTERNS])


def answer_text(content: Column) -> Column:
    """Text of a message content: a plain string, or JSON with an answer."""
    return F.coalesce(F.get_json_object(content, "$.answer"), content)


def conversation_summary(turns: DataFrame) -> DataFrame:
    """First user text, last assistant text and user text count per conversation."""
    def text(role: str) -> Column:
        return F.when(F.col("role") == role, F.col("text"))

    def turn(role: str) -> Column:
        return F.when(F.col("role") == role, F.col("turn"))

    return turns.groupBy("conv_id").agg(
        F.min_by(text("user"), turn("user")).alias("first_prompt"),
        F.max_by(text("assistant"), turn("assistant")).alias("last_answer"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
    )


def chat_messages(turns: DataFrame, system: str = "", offset: int = 0) -> DataFrame:
    """Role and content array per conversation, from position ``offset`` on.

    Even positions speak for the user, odd ones for the assistant; an assistant
    turn without text is dropped, the optional system message comes first. The
    array of a conversation is bounded by its own length.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    tail = F.slice(ordered, offset + 1, F.greatest(F.size(ordered), F.lit(1)))
    spoken = F.transform(tail, lambda m, i: F.struct(
        F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"),
        m["text"].alias("content"),
    ))
    kept = F.filter(spoken, lambda m: (m["role"] == "user") | m["content"].isNotNull())
    if system:
        first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
        kept = F.concat(first, kept)
    return turns.groupBy("conv_id").agg(kept.alias("messages"))
