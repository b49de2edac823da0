"""Score leaderboards from two-round pairwise judgments."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions.draws import numbered_draws
from verdictframe.functions.predicates import short_model_name

OVERALL = "Overall"
# Verdict label -> (score of the answer shown second is this value, weight class).
LABEL_SCORES = {
    "A>B": (1.0, False), "A>>B": (1.0, True), "A=B": (0.5, False),
    "A<<B": (0.0, True), "A<B": (0.0, False), "B>A": (0.0, False),
    "B>>A": (0.0, True), "B=A": (0.5, False), "B<<A": (1.0, True), "B<A": (1.0, False),
}
BLOCK = 4096
DRAWS_PER_TASK = 2_000_000


def complete_games(judgments: DataFrame) -> DataFrame:
    """Rows whose two games both carry a verdict."""
    bad = F.exists("games", lambda g: g.isNull() | g["score"].isNull())
    return judgments.filter(~bad)


def _label_scores(label: Column, weight: int) -> Column:
    cases = F.array(F.lit(None).cast("double"))
    for name, (value, strong) in LABEL_SCORES.items():
        times = weight if strong else 1
        cases = F.when(label == name, F.array(*[F.lit(value)] * times)).otherwise(cases)
    return cases


def score_rows(games: DataFrame, first: str, second: str, weight: int = 3) -> DataFrame:
    """One row per score point: second game as is, first game inverted.

    A strong verdict counts ``weight`` times; an unknown label gives one NULL.
    """
    inverted = F.transform(_label_scores(F.col(first), weight), lambda s: 1 - s)
    points = F.concat(_label_scores(F.col(second), weight), inverted)
    return games.withColumn("score", F.explode(points)).drop(first, second)


def with_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Topic by uid; rows without a known topic are dropped."""
    return rows.join(categories, "uid").filter(F.col("topic").isNotNull())


def score_cells(scores: DataFrame, slice_column: str | None = None) -> DataFrame:
    """Counts per (slice, model, score), with an Overall slice.

    Every statistic below needs only these counts; slices are added after the
    aggregate, so the rows themselves are never multiplied.
    """
    model = short_model_name(F.col("model")).alias("model")
    if slice_column is None:
        base = scores.select(F.lit(OVERALL).alias("slice"), model, "score")
        return base.groupBy("slice", "model", "score").agg(F.count(F.lit(1)).alias("n"))
    base = scores.select(F.trim(F.col(slice_column)).alias("slice"), model, "score")
    cells = base.groupBy("slice", "model", "score").agg(F.count(F.lit(1)).alias("n"))
    both = F.explode(F.array("slice", F.lit(OVERALL)))
    return cells.select(both.alias("slice"), "model", "score", "n").groupBy(
        "slice", "model", "score"
    ).agg(F.sum("n").alias("n"))


def mean_scores(cells: DataFrame) -> DataFrame:
    """Mean score per slice and model, NULL scores left out."""
    n = F.when(F.col("score").isNotNull(), F.col("n"))
    return cells.groupBy("slice", "model").agg(
        (F.sum(F.col("score") * F.col("n")) / F.sum(n)).alias("score")
    )


def bootstrap_means(cells: DataFrame, rounds: int = 100, seed: int = 17) -> DataFrame:
    """Mean per (slice, model, round) of a resample with replacement.

    Resampling n rows is a multinomial draw over the score counts, so a round
    costs a handful of numbers instead of n rows. The generator is seeded by
    the group key: a retried task repeats its draws.
    """

    def resample(key: tuple, cells_pdf: pd.DataFrame) -> pd.DataFrame:
        part = cells_pdf.sort_values("score")
        counts = part["n"].to_numpy(dtype=np.int64)
        values = part["score"].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, *"\x1f".join(map(str, key)).encode()])
        picks = rng.multinomial(counts.sum(), counts / counts.sum(), size=rounds)
        return pd.DataFrame({
            "slice": key[0], "model": key[1],
            "round": np.arange(rounds, dtype=np.int64),
            "mean": picks @ values / counts.sum(),
        })

    return (
        cells.filter(F.col("score").isNotNull())
        .groupBy("slice", "model")
        .applyInPandas(resample, "slice string, model string, round bigint, mean double")
    )


def bootstrap_means_by_draws(cells: DataFrame, rounds: int = 100, seed: int = 17) -> DataFrame:
    """The same statistic from explicit md5 draws, reproducible in plain SQL.

    Draw i of a round picks position ``draw % n`` in the score-sorted rows, which
    the cumulative counts translate into a score. The n draws are generated in
    blocks spread over all tasks, so a hot model is not one task's work; a block is
    drawn as one array and leaves its task as one sum.
    """
    solid = cells.filter(F.col("score").isNotNull())
    # Scores come from a fixed table of labels: a handful of values.
    values = [r["score"] for r in solid.select("score").distinct().orderBy("score").collect()]
    columns = [
        F.coalesce(F.sum(F.when(F.col("score") == v, F.col("n"))), F.lit(0)).alias(f"n{i}")
        for i, v in enumerate(values)
    ]
    spread = solid.groupBy("slice", "model").agg(F.sum("n").alias("size"), *columns)
    blocks = spread.withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK)))
    ).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    # A fixed width by the number of draws: blocks are few bytes each.
    total = spread.agg(F.sum("size")).first()[0] or 0
    cores = cells.sparkSession.sparkContext.defaultParallelism
    width = max(cores, math.ceil(total * rounds / DRAWS_PER_TASK))
    blocks = blocks.repartition(width, "slice", "model", "block", "round")
    blocks = blocks.select(
        "slice", "model", "round", "block", "size", F.array(*[F.col(f"n{i}") for i in range(len(values))]).alias("counts"),
        F.concat_ws(":", F.lit(str(seed)), "slice", "model", F.col("round").cast("string")).alias("prefix"),
    )

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = np.array(values, dtype=float)
        for rows in batches:
            total, drawn = [], []
            for block, size, counts, prefix in zip(rows["block"], rows["size"], rows["counts"], rows["prefix"]):
                picks = numbered_draws(prefix, block * BLOCK, min(size, (block + 1) * BLOCK)) % size
                place = np.searchsorted(np.cumsum(counts), picks, side="right")
                total.append(float(np.bincount(place, minlength=len(score)) @ score))
                drawn.append(len(picks))
            yield rows[["slice", "model", "round"]].assign(total=total, drawn=drawn)

    kinds = [f"{c} {blocks.schema[c].dataType.simpleString()}" for c in ("slice", "model", "round")]
    sums = blocks.mapInPandas(scored, ", ".join([*kinds, "total double", "drawn bigint"]))
    return sums.groupBy("slice", "model", "round").agg((F.sum("total") / F.sum("drawn")).alias("mean"))


def leaderboard(means: DataFrame, baseline: str | None = None) -> DataFrame:
    """Percent score with 5%-95% deltas, and the baseline at 50 when absent."""
    stats = means.groupBy("slice", "model").agg(
        F.avg("mean").alias("mean"),
        F.percentile("mean", F.lit(0.05)).alias("lower"),
        F.percentile("mean", F.lit(0.95)).alias("upper"),
    )
    out = stats.select(
        "slice", "model",
        F.round(F.col("mean") * 100, 1).alias("score_pct"),
        (-F.round((F.col("mean") - F.col("lower")) * 100, 1)).alias("ci_low"),
        F.round((F.col("upper") - F.col("mean")) * 100, 1).alias("ci_high"),
    )
    if baseline is None:
        return out
    lacking = (
        out.groupBy("slice")
        .agg(F.count_if(F.col("model") == baseline).alias("n"))
        .filter("n = 0")
        .select(
            "slice", F.lit(baseline).alias("model"), F.lit(50.0).alias("score_pct"),
            F.lit(0.0).alias("ci_low"), F.lit(0.0).alias("ci_high"),
        )
    )
    return out.unionByName(lacking)


def score_table(means: DataFrame, slices: list[str]) -> DataFrame:
    """One column per slice, outer-merged on the model."""
    return means.groupBy("model").pivot("slice", slices).agg(F.first("score"))


def min_ranks(means: DataFrame) -> DataFrame:
    """Competition ranks per slice, best first; a NULL score has no rank."""
    order = Window.partitionBy("slice").orderBy(F.desc("score"))
    return means.filter(F.col("score").isNotNull()).withColumn(
        "rank", F.rank().over(order).cast("bigint")
    )


def rank_table(means: DataFrame, slices: list[str]) -> DataFrame:
    """Ranks per slice as columns, models ordered by Overall, nulls last.

    Without an Overall slice the mean of the ranks orders the models.
    """
    table = min_ranks(means).groupBy("model").pivot("slice", slices).agg(F.first("rank"))
    if OVERALL in slices:
        key = F.col(OVERALL)
    else:
        ranks = F.array_compact(F.array(*[F.col(f"`{s}`") for s in slices]))
        key = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / F.size(ranks)
    order = Window.partitionBy(F.lit(1)).orderBy(key.asc_nulls_last(), "model")
    return table.withColumn("position", F.row_number().over(order).cast("bigint"))


def ranking_frame(ratings: DataFrame, votes: DataFrame, metadata: DataFrame) -> DataFrame:
    """Public ranking: score, interval, votes, organisation and licence.

    ``ratings(model, rating, margin)``. The rank sorts on the rounded score; a
    zero margin shows no interval.
    """
    joined = ratings.join(votes, "model", "left").join(metadata, "model", "left")
    out = joined.select(
        "model",
        F.round("rating", 1).alias("score"),
        F.when(F.col("margin") > 0, F.round("margin", 1)).alias("ci_margin"),
        F.coalesce("votes", F.lit(0)).alias("votes"),
        F.coalesce("organization", F.lit("Unknown")).alias("organization"),
        F.coalesce("license", F.lit("Unknown")).alias("license"),
    )
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "model")
    return out.withColumn("rank", F.row_number().over(order).cast("bigint"))
