"""Judge-versus-human agreement: confusion counts and the metrics on them.

Everything below the first aggregate works on at most labels x labels rows per
group, so only that aggregate touches the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions.predicates import (
    MERGED_LABELS,
    VOTE_LABELS,
    merged_label,
    present,
    vote_of,
)

ALL = "ALL"


def matched_pairs(judge_rows: DataFrame, human: DataFrame) -> DataFrame:
    """Judge rows joined to the one human vote of their session.

    Judge rows are not de-duplicated. The human side has one row per session,
    so a hot session multiplies nothing.
    """
    judged = judge_rows.filter(present("chat_session_id") & present("judgment")).withColumn(
        "judge_vote", vote_of("judgment")
    ).filter(F.col("judge_vote").isNotNull())
    slim = human.select("chat_session_id", F.col("vote").alias("human_vote"), "category_name")
    return judged.join(slim, "chat_session_id")


def confusion_cells(
    pairs: DataFrame, keys: list[str], truth: str = "human_vote", guess: str = "judge_vote"
) -> DataFrame:
    """Counts per (keys, true, predicted): the only pass over the rows."""
    return pairs.groupBy(*keys, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(
        F.count(F.lit(1)).alias("n")
    )


def with_overall(cells: DataFrame, level: str) -> DataFrame:
    """Cells per value of ``level`` plus the total over all its values."""
    both = F.explode(F.array(F.col(level).cast("string"), F.lit(ALL)))
    rest = [c for c in cells.columns if c not in (level, "n")]
    return cells.select(*rest, both.alias(level), "n").groupBy(*rest, level).agg(
        F.sum("n").alias("n")
    )


def merged_cells(cells: DataFrame) -> DataFrame:
    keys = [c for c in cells.columns if c not in ("truth", "guess", "n")]
    return cells.groupBy(
        *keys, merged_label("truth").alias("truth"), merged_label("guess").alias("guess")
    ).agg(F.sum("n").alias("n"))


def confusion_matrix(cells: DataFrame, keys: list[str], labels: list[str] = VOTE_LABELS) -> DataFrame:
    """Every label x label cell, zeros included."""
    columns = [
        F.coalesce(
            F.sum(F.when((F.col("truth") == t) & (F.col("guess") == g), F.col("n"))), F.lit(0)
        ).alias(f"c_{i}_{j}")
        for i, t in enumerate(labels)
        for j, g in enumerate(labels)
    ]
    wide = cells.groupBy(*keys).agg(*columns)
    grid = F.array(*[
        F.struct(F.lit(t).alias("truth"), F.lit(g).alias("guess"), F.col(f"c_{i}_{j}").alias("n"))
        for i, t in enumerate(labels)
        for j, g in enumerate(labels)
    ])
    return wide.select(*keys, F.explode(grid).alias("cell")).select(*keys, "cell.*")


def _marginals(cells: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    n = F.col("n").cast("double")

    def total(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0.0)).alias(name)

    columns = [F.sum(n).alias("n_all"), total(F.col("truth") == F.col("guess"), "hits")]
    for i, label in enumerate(labels):
        true, pred = F.col("truth") == label, F.col("guess") == label
        columns += [total(true & pred, f"tp{i}"), total(true, f"t{i}"), total(pred, f"p{i}")]
    return cells.groupBy(*keys).agg(*columns)


def ratio(top: Column, bottom: Column) -> Column:
    """Division where an empty denominator counts as 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / F.nullif(bottom, F.lit(0.0)))


def _class_columns(i: int) -> tuple[Column, Column, Column]:
    tp, t, p = F.col(f"tp{i}"), F.col(f"t{i}"), F.col(f"p{i}")
    return ratio(tp, p), ratio(tp, t), ratio(2 * tp, t + p)


def per_class(cells: DataFrame, keys: list[str], labels: list[str] = VOTE_LABELS) -> DataFrame:
    """Precision, recall, F1, support and per-class agreement of each label.

    The agreement of a class is the share of its true rows judged the same,
    0 for an absent class, i.e. its recall.
    """
    rows = []
    for i, label in enumerate(labels):
        precision, recall, f1 = _class_columns(i)
        rows.append(
            F.struct(
                F.lit(label).alias("label"),
                precision.alias("precision"),
                recall.alias("recall"),
                f1.alias("f1"),
                F.col(f"t{i}").cast("bigint").alias("support"),
                F.col(f"p{i}").cast("bigint").alias("predicted"),
            )
        )
    wide = _marginals(cells, keys, labels)
    return wide.select(*keys, F.explode(F.array(*rows)).alias("c")).select(*keys, "c.*")


def metrics(cells: DataFrame, keys: list[str], labels: list[str] = VOTE_LABELS) -> DataFrame:
    """Accuracy, macro and micro averages, Cohen's kappa and Matthews correlation.

    Macro averages run over all listed labels, absent ones included. Kappa is
    NULL where chance agreement is total; Matthews is 0 where undefined.
    """
    wide = _marginals(cells, keys, labels)
    size = range(len(labels))

    def add(columns: list[Column]) -> Column:
        return reduce(lambda x, y: x + y, columns)

    n = F.col("n_all")
    classes = [_class_columns(i) for i in size]
    k = float(len(labels))
    tp = add([F.col(f"tp{i}") for i in size])
    t = add([F.col(f"t{i}") for i in size])
    p = add([F.col(f"p{i}") for i in size])
    agree = add([F.col(f"t{i}") * F.col(f"p{i}") for i in size])
    t2 = add([F.col(f"t{i}") * F.col(f"t{i}") for i in size])
    p2 = add([F.col(f"p{i}") * F.col(f"p{i}") for i in size])
    po, pe = F.col("hits") / n, agree / (n * n)
    spread = F.sqrt((n * n - p2) * (n * n - t2))
    micro_p, micro_r = ratio(tp, p), ratio(tp, t)
    return wide.select(
        *keys,
        n.cast("bigint").alias("n_samples"),
        po.alias("accuracy"),
        (add([c[0] for c in classes]) / k).alias("macro_precision"),
        (add([c[1] for c in classes]) / k).alias("macro_recall"),
        (add([c[2] for c in classes]) / k).alias("macro_f1"),
        micro_p.alias("micro_precision"),
        micro_r.alias("micro_recall"),
        ratio(2 * tp, t + p).alias("micro_f1"),
        F.when(pe < 1, (po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("cohen_kappa"),
        ratio(F.col("hits") * n - agree, spread).alias("matthews_corrcoef"),
    )


def label_distributions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """True and predicted counts per label."""
    both = F.explode(F.array(
        F.struct(F.lit("true").alias("side"), F.col("truth").alias("label")),
        F.struct(F.lit("predicted").alias("side"), F.col("guess").alias("label")),
    ))
    return cells.select(*keys, both.alias("d"), "n").groupBy(*keys, "d.side", "d.label").agg(
        F.sum("n").alias("n")
    )


def merged_comparison(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Four-class and merged three-class metrics with their differences."""
    four = metrics(cells, keys, VOTE_LABELS)
    three = metrics(merged_cells(cells), keys, MERGED_LABELS)
    out = four.select(*keys, "n_samples", "accuracy", "macro_f1").join(
        three.select(
            *keys,
            F.col("accuracy").alias("merged_accuracy"),
            F.col("macro_f1").alias("merged_macro_f1"),
        ),
        keys,
    )
    for name in ("accuracy", "macro_f1"):
        change = F.col(f"merged_{name}") - F.col(name)
        out = out.withColumn(f"{name}_gain", change)
        out = out.withColumn(f"{name}_gain_pct", ratio(change * 100, F.col(name)))
    return out


def mode_comparison(system_metrics: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean accuracy with and without execution results, and the difference."""

    def mean(mode: str) -> Column:
        return F.avg(F.when(F.col("mode") == mode, F.col("accuracy")))

    out = system_metrics.groupBy(*by).agg(
        mean("with_execution").alias("with_execution"),
        mean("without_execution").alias("without_execution"),
    )
    change = F.col("with_execution") - F.col("without_execution")
    return out.withColumn("difference", change).withColumn(
        "difference_pct", ratio(change * 100, F.col("without_execution"))
    )


def merged_summary(system_metrics: DataFrame, system: str = "system") -> DataFrame:
    """Two rankings of the systems; one row per system, so one window is fine."""
    def by(metric: str) -> Column:
        return F.row_number().over(
            Window.partitionBy(F.lit(1)).orderBy(F.desc(metric), F.col(system))
        ).cast("bigint")

    return system_metrics.select(
        system, "n_samples", "accuracy", "macro_f1",
        by("accuracy").alias("accuracy_rank"), by("macro_f1").alias("macro_f1_rank"),
    )


def metric_rankings(system_metrics: DataFrame, system: str, names: list[str]) -> DataFrame:
    """One ranking per metric, best first."""
    long = system_metrics.select(
        system, "n_samples",
        F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in names
        ])).alias("m"),
    ).select(system, "n_samples", "m.metric", "m.score")
    order = Window.partitionBy("metric").orderBy(F.desc("score"), F.col(system))
    return long.withColumn("rank", F.row_number().over(order).cast("bigint"))


def best_system(system_metrics: DataFrame, system: str, names: list[str]) -> DataFrame:
    """The winner per metric."""
    return system_metrics.agg(*[
        F.max_by(system, F.struct(F.col(m), F.col("n_samples"))).alias(f"best_{m}") for m in names
    ])
