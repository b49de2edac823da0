"""Vote streams: ingestion, running counts and leaderboard refresh.

Batch-wise writers put their rows into a folder per micro-batch number and
replace that folder when a batch is retried, so every vote counts exactly once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdictframe.operators import battles, ratings
from verdictframe.session import folder_names
from verdictframe.sources.jsonl import VOTE


def vote_stream(
    spark: SparkSession, folder: str, schema: str = VOTE, files_per_trigger: int | None = None,
    kind: str = "json",
) -> DataFrame:
    """Votes as they land; the schema is fixed, the trigger size bounded."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def _started(writer, interval: str | None) -> StreamingQuery:
    """All available input once, or a batch per interval."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def ingest(votes: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append votes to a Parquet table; nothing stored is ever rewritten."""
    writer = votes.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint
    ).option("path", path)
    return _started(writer, interval)


def running_stats(votes: DataFrame) -> DataFrame:
    """Running win, tie and loss counts per model, for complete or update mode."""
    return battles.sides(battles.winners(votes), [], "winner").groupBy("model").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("result") == "win").alias("wins"),
        F.count_if(F.col("result") == "tie").alias("ties"),
        F.count_if(F.col("result") == "loss").alias("losses"),
    )


def per_batch(
    rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str,
    interval: str | None = None, mode: str = "append",
) -> StreamingQuery:
    """Run ``step(batch, number)``; a retried batch gets the same number."""
    writer = rows.writeStream.outputMode(mode).foreachBatch(step).option(
        "checkpointLocation", checkpoint
    )
    return _started(writer, interval)


def keep_step(path: str) -> Callable[[DataFrame, int], None]:
    """Store each batch as a folder of its own."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


COUNTS = ("a_win", "b_win", "tie")


def pair_count_step(path: str) -> Callable[[DataFrame, int], None]:
    """Store the running outcome counts after each batch.

    Counts of batches simply add, so a batch reads the total of the one before
    and nothing older; a retried batch starts from the same total.
    """

    def step(batch: DataFrame, number: int) -> None:
        counts = battles.pair_outcomes(battles.winners(batch), [], "winner").select("model_a", "model_b", *COUNTS)
        before = newest(batch.sparkSession, path, number)
        if before is not None:
            counts = counts.unionByName(before).groupBy("model_a", "model_b").agg(*[F.sum(c).alias(c) for c in COUNTS])
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def stored_pair_counts(spark: SparkSession, path: str) -> DataFrame:
    return newest(spark, path)


def leaderboard_step(counts_path: str, board_path: str) -> Callable[[DataFrame, int], None]:
    """Add the batch to the counts and refit: old votes are never read again."""
    add = pair_count_step(counts_path)

    def step(batch: DataFrame, number: int) -> None:
        add(batch, number)
        counts = stored_pair_counts(batch.sparkSession, counts_path)
        ratings.fit_pairs(counts, [], "bt").write.mode("overwrite").parquet(
            f"{board_path}/batch={number}"
        )

    return step


def newest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """Rows of the highest stored batch (below a number), None without one."""
    numbers = [n for n in batch_numbers(spark, path) if below is None or n < below]
    return spark.read.parquet(f"{path}/batch={max(numbers)}") if numbers else None


def batch_numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored batches, from the folder names alone.

    A stream starts a batch only after the one before is complete, so every
    number below the current one can be relied on.
    """
    found = [name.partition("batch=") for name in folder_names(spark, path)]
    return sorted(int(number) for head, mark, number in found if mark and not head)
