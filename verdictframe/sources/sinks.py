"""Sinks: pruned copies, partitioned writes, previews, reports, split outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.operators.agreement import ratio
from verdictframe.session import move_aside

PREVIEW = 150


def safe_name(column: Column) -> Column:
    """File-system name of a category."""
    return F.lower(F.replace(F.replace(column, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("_")))


def write_pruned(df: DataFrame, path: str, drop: list[str] = (), mode: str = "overwrite") -> None:
    """JSON-lines copy without the heavy columns, which are never read."""
    df.drop(*drop).write.mode(mode).json(path)


def write_by_category(df: DataFrame, path: str, category: str = "category", mode: str = "overwrite") -> DataFrame:
    """One folder per category; returns the counts per category.

    Rows without uid or instruction are skipped. A category is written by as
    many tasks as hold its rows, so a hot one is not a single writer's work.
    """
    kept = df.filter(
        (F.coalesce(F.col("uid").cast("string"), F.lit("")) != "")
        & (F.coalesce("instruction", F.lit("")) != "")
    ).withColumn(category, F.coalesce(category, F.lit("uncategorized")))
    kept.withColumn("safe_category", safe_name(F.col(category))).write.mode(mode).partitionBy(
        "safe_category"
    ).json(path)
    return category_counts(kept, category)


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    return df.groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def log_partitions(df: DataFrame, start: str) -> DataFrame:
    """Date and mode folder columns of a log row."""
    return df.withColumn("date", F.date_format(start, "yyyy_MM_dd"))


def write_logs(df: DataFrame, path: str, start: str, mode: str = "append") -> None:
    log_partitions(df, start).write.mode(mode).partitionBy("date", "chat_mode").json(path)


def csv_rows(tasks: DataFrame) -> DataFrame:
    """Task table with a one-line preview of the instruction."""
    head = F.substring("instruction", 1, PREVIEW)
    flat = F.replace(F.replace(head, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    preview = F.concat(flat, F.when(F.length("instruction") > PREVIEW, "...").otherwise(""))
    return tasks.withColumn("preview", preview)


def write_csv(tasks: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    csv_rows(tasks).select(*columns).write.mode(mode).option("header", True).csv(path)


def category_report(tasks: DataFrame, category: str = "category") -> DataFrame:
    """Tasks and share per category; one row per category."""
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # over the few counts
    return category_counts(tasks, category).select(
        F.col("category"), F.col("n").alias("count"),
        F.round(ratio(F.col("n") * 100.0, total.cast("double")), 1).alias("percentage"),
    )


def write_report(tasks: DataFrame, path: str, columns: list[str], category: str = "category") -> None:
    """Report folders: counts, and the member tasks partitioned by category.

    Members stay rows in category folders; nesting them in one record per
    category would make one task hold a whole category.
    """
    category_report(tasks, category).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    tasks.select(*columns, F.col(category).alias("group")).write.mode("overwrite").partitionBy(
        "group"
    ).json(f"{path}/members")


def sanitised(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, scalars as they are."""
    nested = ("struct", "array", "map")
    return df.select(*[
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name)
        for f in df.schema.fields
    ])


def split_outcome(results: DataFrame, judge: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(succeeded, failed) results; failures carry message, time and judge."""
    good = results.filter(F.col("error").isNull()).drop("error")
    bad = results.filter(F.col("error").isNotNull()).withColumn(
        "processing_error",
        F.struct(
            F.col("error").alias("error_message"), at.cast("string").alias("timestamp"),
            F.lit(judge).alias("judge_model"),
        ),
    ).drop("error")
    return good, bad


def write_outcome(
    results: DataFrame, path: str, failed_path: str, judge: str, retry: bool = False,
    at: Column | None = None,
) -> tuple[str | None, str | None]:
    """Both outputs with nested values as JSON text; appended on a retry.

    Otherwise the outputs of an earlier run move to a backup folder beside them
    first; their names are returned (None where there was none).
    """
    good, bad = split_outcome(results, judge, at if at is not None else F.current_timestamp())
    backups = (None, None)
    if not retry:
        backups = tuple(move_aside(results.sparkSession, p) for p in (path, failed_path))
    sanitised(good).write.mode("append").json(path)
    sanitised(bad).write.mode("append").json(failed_path)
    return backups


def append_votes(new: DataFrame, path: str) -> None:
    """Add votes to the stored table as new files; stored files are never rewritten."""
    new.write.mode("append").parquet(path)


# Kinds of visual files by extension.
FILE_KINDS = {
    "png": ["png"], "jpeg": ["jpg", "jpeg"], "gif": ["gif"], "svg": ["svg"],
    "html": ["html", "htm"], "javascript": ["js"], "json": ["json"],
    "markdown": ["md", "markdown"], "latex": ["tex", "latex"],
}
BINARY_KINDS = ["png", "jpeg", "gif"]


def new_visual_files(current: DataFrame, initial: DataFrame) -> DataFrame:
    """New files by kind, one per content digest, the first path kept.

    ``current(path, content)`` as the binary-file source gives it, ``initial(path)``
    the listing before the run. Only the digest takes part in the joins and shuffles.
    """
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    cases = [F.when(extension.isin(exts), F.lit(kind)) for kind, exts in FILE_KINDS.items()]
    digests = current.select("path", F.sha2("content", 256).alias("digest"), reduce(F.coalesce, cases).alias("kind"))
    fresh = digests.join(initial.select("path"), "path", "left_anti")
    first = fresh.groupBy("digest").agg(F.min_by(F.struct("path", "kind"), "path").alias("f"))
    return first.select("f.path", "f.kind", "digest").filter(F.col("kind").isNotNull())


def visual_data(kind: Column, content: Column) -> Column:
    """Pictures as base64, all other kinds as text."""
    return F.when(kind.isin(BINARY_KINDS), F.base64(content)).otherwise(
        F.decode(content, "UTF-8")
    )
