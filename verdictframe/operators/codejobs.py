"""Jobs over an answers table: code extraction, packages, environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdictframe.functions import codeblocks as cb
from verdictframe.functions.predicates import present, squeeze


def extract_code(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Main block per answer with language, environment and dependencies.

    Answers without any fenced block keep NULLs. Blocks are found once and kept
    as an array column, so the regular expressions run one time per answer.
    """
    blocks = answers.withColumn("_blocks", cb.fenced_blocks(F.col(answer)))
    picked = blocks.withColumn("_main", cb.main_block(F.col("_blocks")))
    lang, code = F.col("_main.lang"), F.col("_main.code")
    environment, language = cb.route(lang, code)
    python, npm = cb.block_dependencies(lang, code, F.col("_blocks"))
    found = F.col("_main").isNotNull()
    python_block = cb.starts_with_any(lang, cb.PYTHON_PREFIXES)
    return picked.select(
        *answers.columns,
        lang.alias("block_lang"),
        F.when(python_block, cb.without_inline_pip(code)).otherwise(code).alias("code_to_execute"),
        F.when(found, language).alias("language"),
        F.when(found, environment).alias("environment"),
        F.when(found, F.struct(python.alias("python"), npm.alias("npm"))).alias("code_dependencies"),
    )


def generations_from_solutions(solutions: DataFrame, solution: str = "solution") -> DataFrame:
    """Solutions as generation records; fence-less code by substring rules.

    Rows without uid or code are skipped; an unknown environment runs as Python.
    """
    kept = solutions.filter(present(F.col("uid").cast("string")) & present(solution))
    rows = extract_code(kept, solution).withColumn("_low", F.lower(solution)).withColumn(
        "_head", F.substring(squeeze(F.col(solution)), 1, 20)
    )
    environment, language = cb.fallback_environment(F.col(solution), F.col("_low"), F.col("_head"))
    fenced = F.col("code_to_execute").isNotNull()
    return rows.select(
        *[c for c in kept.columns],
        F.coalesce("code_to_execute", solution).alias("code_to_execute"),
        F.when(fenced, F.col("language")).otherwise(language).alias("language"),
        F.when(fenced, F.coalesce("environment", F.lit("Python Runner")))
        .otherwise(environment).alias("environment"),
    )


def package_usage(answers: DataFrame, packages: Column, kind: str) -> DataFrame:
    """How many answers use each package; counts combine before the shuffle."""
    rows = answers.select(F.explode(packages).alias("package"))
    return rows.groupBy("package").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))


def reclassified(generations: DataFrame, answer: str, old: str = "environment") -> DataFrame:
    """Stored generations with their environment computed anew.

    The old value stays where the new one is NULL; ``changed`` marks the rest.
    """
    fresh = extract_code(generations.withColumnRenamed(old, "old_environment"), answer)
    new = F.coalesce("environment", "old_environment")
    return fresh.select(
        "uid", "old_environment", new.alias("new_environment"),
        (~new.eqNullSafe(F.col("old_environment"))).alias("changed"),
    )


def empty_answers(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Worklist of answers to regenerate: empty, or without any code block."""
    empty = F.col(answer).isNull() | (F.trim(F.col(answer)) == "")
    no_code = ~empty & (F.size(cb.fenced_blocks(F.col(answer))) == 0)
    reason = F.when(empty, "empty").when(no_code, "no_code")
    return answers.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def execution_validity(generations: DataFrame) -> DataFrame:
    """Why a generation cannot run, NULL when it can."""
    uid = present(F.col("uid").cast("string"))
    status = F.when(~(uid & present("environment")), "Missing required fields").when(
        ~present("code_to_execute"), "No code to execute"
    )
    return generations.withColumn("problem", status)
