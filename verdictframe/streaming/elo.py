"""Online Elo over a vote stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdictframe.functions.predicates import a_score
from verdictframe.operators import ratings
from verdictframe.streaming.votes import newest


def elo_step(
    path: str, keys: list[str], order: str = "seq", outcome: str = "vote", **elo
) -> Callable[[DataFrame, int], None]:
    """Fold each batch onto the ratings of the batch before.

    The rating table of every batch is a folder of its own: a retried batch
    starts again from its predecessor. Inside a batch the bounded-chunk fold
    keeps order, also where one system holds most of the rows. Late votes are
    applied when they arrive.
    """

    def step(batch: DataFrame, number: int) -> None:
        start = newest(batch.sparkSession, path, number)
        fold = ratings.online_elo(batch, keys, order, outcome, start=start, **elo)
        fold.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


def keyed_elo(
    votes: DataFrame, key: str = "system", order: str = "seq", outcome: str = "vote",
    k: float = ratings.K_FACTOR, scale: float = ratings.SCALE, base: float = ratings.BASE,
    init: float = ratings.INIT,
) -> DataFrame:
    """The same fold as keyed state: the rating map of one system is its state.

    Emits the changed ratings of every trigger. A trigger's rows of one system
    are ordered in one task at 24 bytes each, so bound the trigger size; for systems too large for
    that use :func:`elo_step`.
    """
    schema = T.StructType([
        votes.schema[key],
        T.StructField("model", T.StringType()), T.StructField("rating", T.DoubleType()),
    ])
    memory = "models array<string>, ratings array<double>, seen array<boolean>"

    def fold(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: dict[str, list] = {}
        if state.exists:
            known = {m: [r, s] for m, r, s in zip(*state.get)}
        rows = ratings.Battles(order)
        for batch in batches:
            rows.add(batch)
        named = rows.fold(known, k, scale, base, init)
        state.update((
            list(known), [float(v[0]) for v in known.values()], [bool(v[1]) for v in known.values()]
        ))
        touched = sorted(named)
        yield pd.DataFrame({
            key: group[0], "model": touched, "rating": [float(known[m][0]) for m in touched],
        })

    slim = votes.select(key, order, "model_a", "model_b", a_score(outcome).alias("score"))
    return slim.groupBy(key).applyInPandasWithState(
        fold, schema, memory, "update", GroupStateTimeout.NoTimeout
    )


def latest_ratings(changes: DataFrame, key: str = "system") -> DataFrame:
    """Current rating per model from the stored changes with their batch number."""
    return changes.groupBy(key, "model").agg(F.max_by("rating", "batch").alias("rating"))
