"""Answer quality, verdict and execution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions.predicates import squeeze
from verdictframe.functions.quality import answer_quality
from verdictframe.functions import verdicts
from verdictframe.functions.verdicts import DIMENSIONS, RATING_LEVELS, evaluation
from verdictframe.operators.agreement import ratio
from verdictframe.operators.battles import first_per_class

TOTAL = "TOTAL"


def parsed_replies(replies: DataFrame, reply: str) -> DataFrame:
    """Judge replies with their ``json``: as is, else repaired, else its first object.

    Each repair is its own step, so a text is parsed once per step and only where
    the earlier ones failed.
    """
    text = F.col(reply)
    out = replies.withColumn("_w", verdicts.in_array(text))
    out = out.withColumn("_v", verdicts.only_value(F.col("_w")))
    out = out.withColumn("_fixed", F.when(F.col("_v").isNull(), verdicts.repaired(text)))
    out = out.withColumn("_w", verdicts.in_array(F.col("_fixed")))
    out = out.withColumn("_v", F.coalesce("_v", verdicts.only_value(F.col("_w"))))
    cut = F.col("_v").isNull() & ~F.col("_fixed").startswith("{")
    out = out.withColumn("_cut", F.when(cut, verdicts.first_balanced_object(F.col("_fixed"))))
    out = out.withColumn("_w", verdicts.in_array(F.col("_cut")))
    json = F.coalesce("_v", verdicts.only_value(F.col("_w")))
    return out.select(*replies.columns, json.alias("json"))


def voted_replies(replies: DataFrame, reply: str) -> DataFrame:
    """Vote of each reply: by its JSON, else by keywords, else ``error``."""
    rows = parsed_replies(replies, reply).withColumn("_vote", verdicts.overall_vote(F.col("json")))
    by_words = F.coalesce(verdicts.keyword_vote(F.col(reply)), F.lit("error"))
    vote = F.when(F.col("_vote") != "error", F.col("_vote")).otherwise(by_words)
    return rows.select(*replies.columns, vote.alias("vote"))


def graded_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    return answers.withColumn("q", answer_quality(F.col(answer))).select(*answers.columns, "q.*")


def quality_summary(graded: DataFrame) -> DataFrame:
    """Passed, failed and error counts per category, with a TOTAL row.

    A rollup: the categories are counted once and the total is theirs.
    """
    return (
        graded.select(F.coalesce("category", F.lit("unknown")).alias("category"), "passed", "failed_run", "score")
        .rollup("category")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("passed")).alias("passed"),
            F.count_if(~F.col("passed") & ~F.col("failed_run")).alias("failed"),
            F.count_if(F.col("failed_run")).alias("errors"),
            F.avg("score").alias("mean_score"),
        )
        .select(
            F.coalesce("category", F.lit(TOTAL)).alias("category"),
            "total", "passed", "failed", "errors",
            (F.col("passed") / F.col("total") * 100).alias("pass_rate"),
            "mean_score",
        )
    )


def example_answers(graded: DataFrame, order: str = "uid") -> DataFrame:
    """Two passed, two failed and one error answer, earliest first."""
    kind = F.when(F.col("failed_run"), "error").when(F.col("passed"), "passed").otherwise("failed")
    picked = first_per_class(graded.withColumn("class", kind), ["class"], [F.col(order)], 2)
    return picked.filter((F.col("class") != "error") | (F.col("position") == 1))


def verdict_summary(responses: DataFrame, keys: list[str] = ()) -> DataFrame:
    """PASS, PARTIAL and other verdicts with the mean score."""
    keys = list(keys)
    rows = responses.select(*keys, evaluation(F.col("response")).alias("e"))
    verdict = F.col("e.verdict")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(verdict == "PASS").alias("passed"),
        F.count_if(verdict == "PARTIAL").alias("partial"),
        F.count_if(~verdict.isin("PASS", "PARTIAL")).alias("failed"),
        F.avg("e.score").alias("mean_score"),
    )


def rating_distribution(assessments: DataFrame) -> DataFrame:
    """Counts per dimension and rating, levels in their own order."""
    long = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(f"assessment.{d}.rating").alias("rating"))
        for d in DIMENSIONS
    ]))
    level = F.array_position(F.array(*[F.lit(r) for r in RATING_LEVELS]), F.col("rating"))
    return (
        assessments.select(long.alias("r")).select("r.*")
        .filter(F.col("rating").isNotNull())
        .groupBy("dimension", "rating").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("level", level)
    )


def questionable(assessments: DataFrame) -> DataFrame:
    """Questions with a poor or very poor rating, and in which dimensions."""
    bad = F.array_compact(F.array(*[
        F.when(F.col(f"assessment.{d}.rating").isin("very poor", "poor"), F.lit(d)) for d in DIMENSIONS
    ]))
    return assessments.withColumn("issues", F.array_join(bad, ", ")).filter(F.col("issues") != "")


# ------------------------------------------------------------------ execution

def succeeded(stderr: Column) -> Column:
    return squeeze(F.coalesce(stderr, F.lit(""))) == ""


def execution_summary(executions: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Totals and success rates overall, by environment and by category.

    One pass counts the (environment, category) cells; the three levels are sums
    of those. No executions give a NULL rate.
    """
    keys = list(keys)
    cells = executions.groupBy(
        *keys,
        F.coalesce("environment", F.lit("Unknown")).alias("environment"),
        F.coalesce("category", F.lit("Unknown")).alias("category"),
    ).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(succeeded(F.col("stderr"))).alias("success"),
        F.count_if(F.col("stderr") == "No code to execute").alias("no_code"),
        F.count_if(F.col("stderr") == "Missing required fields").alias("missing_fields"),
    )
    level = F.explode(F.array(
        F.struct(F.lit("overall").alias("level"), F.lit("").alias("value")),
        F.struct(F.lit("environment").alias("level"), F.col("environment").alias("value")),
        F.struct(F.lit("category").alias("level"), F.col("category").alias("value")),
    ))
    counts = ("total", "success", "no_code", "missing_fields")
    long = cells.withColumn("at", level).groupBy(*keys, "at.level", "at.value")
    out = long.agg(*[F.sum(c).alias(c) for c in counts])
    return out.withColumn("failed", F.col("total") - F.col("success")).withColumn(
        "success_rate", F.col("success") / F.nullif(F.col("total"), F.lit(0)) * 100
    )


def compare_two(summary: DataFrame, left: str, right: str) -> DataFrame:
    """Success rates of two models per level and value, missing ones as 0."""

    def side(model: str, column: str) -> Column:
        value = F.max(F.when(F.col("model") == model, F.col(column)))
        return F.coalesce(value, F.lit(0).cast("double" if column == "success_rate" else "bigint"))

    out = summary.filter(F.col("model").isin(left, right)).groupBy("level", "value").agg(
        side(left, "success_rate").alias("rate_left"), side(right, "success_rate").alias("rate_right"),
        side(left, "success").alias("success_left"), side(right, "success").alias("success_right"),
        side(left, "total").alias("total_left"), side(right, "total").alias("total_right"),
    )
    gap = F.col("rate_left") - F.col("rate_right")
    winner = F.when(gap > 0, left).when(gap < 0, right).otherwise("equal")
    return out.withColumn("difference", gap).withColumn("winner", winner)


def compare_many(summary: DataFrame, models: list[str], level: str) -> DataFrame:
    """One success-rate column per model, missing ones as 0."""
    rows = summary.filter(F.col("level") == level).groupBy("value")
    return rows.pivot("model", models).agg(F.first("success_rate")).fillna(0.0)


def strongest_environments(summary: DataFrame, k: int = 3) -> DataFrame:
    """The k environments with the best success rate per model."""
    rows = summary.filter(F.col("level") == "environment")
    return first_per_class(rows, ["model"], [F.desc("success_rate"), F.col("value")], k)


def coverage(solutions: DataFrame) -> DataFrame:
    """How many generated questions have a solution, and parsed tests."""
    return solutions.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.col("solution"), F.lit("")) != "").alias("with_solution"),
        F.count_if(F.col("test_cases").isNotNull()).alias("with_tests"),
    )


def shares(rows: DataFrame, by: str) -> DataFrame:
    """Rows per value of a column and their share of all rows in percent."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the few counts
    return counts.withColumn("share_pct", ratio(F.col("n") * 100.0, total.cast("double")))
