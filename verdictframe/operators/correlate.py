"""Correlations between rating systems."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from verdictframe.functions.pairfit import correlation_p_value


@pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([
        None if a is None or a != a else correlation_p_value(a, int(b)) for a, b in zip(r, n)
    ], dtype="float64")


def system_pairs(ratings: DataFrame) -> DataFrame:
    """Rating pairs of the models two systems share, each pair of systems once."""
    left = ratings.select(F.col("system").alias("system1"), "model", F.col("rating").alias("x"))
    right = ratings.select(F.col("system").alias("system2"), "model", F.col("rating").alias("y"))
    return left.join(right, "model").filter(F.col("system1") < F.col("system2"))


def _average_rank(value: str, keys: list[str]) -> Column:
    order = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2


def correlations(pairs: DataFrame, method: str = "spearman", alpha: float = 0.05) -> DataFrame:
    """Correlation with p-value per system pair; NULL below three common models."""
    keys = ["system1", "system2"]
    if method == "spearman":
        pairs = pairs.withColumn("rx", _average_rank("x", keys)).withColumn(
            "ry", _average_rank("y", keys)
        )
        x, y = "rx", "ry"
    elif method == "pearson":
        x, y = "x", "y"
    else:
        raise ValueError(f"unknown method {method}")
    stats = pairs.groupBy(*keys).agg(
        F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("common_models")
    )
    enough = F.col("common_models") >= 3
    out = stats.withColumn("correlation", F.when(enough & ~F.isnan("r"), F.col("r"))).drop("r")
    out = out.withColumn("p_value", p_value("correlation", "common_models"))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def correlation_cells(corr: DataFrame, systems: DataFrame) -> DataFrame:
    """Full symmetric matrix in long form: diagonal 1 / p 0, missing 0 / p 1."""
    value = F.coalesce("correlation", F.lit(0.0)).alias("correlation")
    p = F.coalesce("p_value", F.lit(1.0)).alias("p_value")
    upper = corr.select("system1", "system2", value, p)
    lower = corr.select(
        F.col("system2").alias("system1"), F.col("system1").alias("system2"), value, p
    )
    names = systems.select("system").distinct()
    diagonal = names.select(
        F.col("system").alias("system1"), F.col("system").alias("system2"),
        F.lit(1.0).alias("correlation"), F.lit(0.0).alias("p_value"),
    )
    return upper.unionByName(lower).unionByName(diagonal)


def correlation_matrix(cells: DataFrame, systems: list[str]) -> DataFrame:
    return cells.groupBy("system1").pivot("system2", systems).agg(F.first("correlation")).fillna(0.0)


def trend_lines(pairs: DataFrame) -> DataFrame:
    """Least-squares line of the second system's ratings on the first's."""
    return pairs.groupBy("system1", "system2").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")
    )


def parsed_system(column: Column) -> tuple[Column, Column]:
    """Judge and mode from ``judge (mode)``; NULL for other names."""
    pattern = r"^(.*) \((\w+)\)$"
    return (
        F.nullif(F.regexp_extract(column, pattern, 1), F.lit("")),
        F.nullif(F.regexp_extract(column, pattern, 2), F.lit("")),
    )


def correlation_rankings(corr: DataFrame, human: str = "Human Votes") -> DataFrame:
    """Four rankings: human vs judge, with vs without, same mode, all pairs."""
    judge1, mode1 = parsed_system(F.col("system1"))
    judge2, mode2 = parsed_system(F.col("system2"))
    with_human = (F.col("system1") == human) | (F.col("system2") == human)
    kinds = F.array_compact(F.array(
        F.lit("all_pairs"),
        F.when(with_human, "human_vs_judge"),
        F.when((judge1 == judge2) & (mode1 != mode2), "with_vs_without"),
        F.when((mode1 == mode2) & (judge1 != judge2), F.concat(F.lit("same_mode:"), mode1)),
    ))
    rows = corr.filter(F.col("correlation").isNotNull()).withColumn("ranking", F.explode(kinds))
    order = Window.partitionBy("ranking").orderBy(F.desc("correlation"), "system1", "system2")
    return rows.withColumn("rank", F.row_number().over(order).cast("bigint"))
