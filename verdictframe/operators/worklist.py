"""Worklists, progress, battle pair assignment and seed samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.functions.draws import dense_index, draw, shuffled_position, uniform
from verdictframe.session import broadcast_if_small

CELLS = 1024
RIVALS_PER_BLOCK = 256


def judge_tasks(
    questions: DataFrame, answers: DataFrame, done: DataFrame, baseline: str, judge: str
) -> DataFrame:
    """Comparisons still to judge: both answers exist, both orders per pair.

    ``answers(model, uid, ...)`` and ``done(model, uid)`` have one row per key.
    """
    base = answers.filter(F.col("model") == baseline).select("uid", F.col("answer").alias("baseline_answer"))
    other = answers.filter(F.col("model") != baseline)
    open_pairs = other.join(done.select("model", "uid"), ["model", "uid"], "left_anti")
    rows = open_pairs.join(base, "uid").join(questions.select("uid", "instruction"), "uid")
    orders = F.explode(F.array(
        F.struct(F.lit(1).alias("round"), F.col("baseline_answer").alias("answer_a"), F.col("answer").alias("answer_b")),
        F.struct(F.lit(2).alias("round"), F.col("answer").alias("answer_a"), F.col("baseline_answer").alias("answer_b")),
    ))
    return rows.select(
        "uid", "instruction", "model", F.lit(baseline).alias("baseline"), F.lit(judge).alias("judge"),
        orders.alias("game"),
    ).select("uid", "instruction", "model", "baseline", "judge", "game.*")


def open_records(records: DataFrame, status: DataFrame, key: str, retry_failed: bool = False) -> DataFrame:
    """Records without a final status; failed ones return only on a retry."""
    closed = status.filter(F.col("state") == "completed") if retry_failed else status.filter(
        F.col("state").isin("completed", "failed")
    )
    return records.join(closed.select(key).distinct(), key, "left_anti")


def progress(status: DataFrame, open_count: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Totals of a run: worklist plus completed, plus failed unless retried.

    ``status(key, state)`` holds one row per key, ``open_count`` the worklist.
    """
    counts = status.groupBy().agg(
        F.count_if(F.col("state") == "completed").alias("completed"),
        F.count_if(F.col("state") == "failed").alias("failed"),
        F.lit(0).cast("bigint").alias("open"),
    )
    rest = open_count.groupBy().agg(
        F.lit(0).cast("bigint").alias("completed"), F.lit(0).cast("bigint").alias("failed"),
        F.count(F.lit(1)).alias("open"),
    )
    both = counts.unionByName(rest).agg(*[F.sum(c).alias(c) for c in ("completed", "failed", "open")])
    total = F.col("open") + F.col("completed")
    if not retry_failed:
        total = total + F.col("failed")
    return both.select(
        total.alias("total"), "completed", "failed",
        (total - F.col("completed") - F.col("failed")).alias("remaining"),
        F.when(total > 0, F.col("completed") / F.nullif(total, F.lit(0))).otherwise(0.0).alias("completion_rate"),
    )


# ------------------------------------------------------------- pair assignment

def _intervals(weights: DataFrame, keys: list[str], item: str, weight: str) -> DataFrame:
    """[lo, hi) of each item in proportion to its weight, per key.

    All-zero weights share evenly. The last interval ends above 1, so rounding
    leaves no gap.
    """
    whole = Window.partitionBy(*keys)
    running = whole.orderBy(item).rowsBetween(Window.unboundedPreceding, 0)
    last = F.row_number().over(whole.orderBy(F.desc(item))) == 1
    total = F.sum(weight).over(whole)
    rows = weights.withColumn("_w", F.when(total > 0, F.col(weight)).otherwise(F.lit(1.0)))
    rows = rows.withColumn("_hi", F.sum("_w").over(running) / F.sum("_w").over(whole))
    before = F.lag("_hi", 1, 0.0).over(whole.orderBy(item))
    return rows.select(
        *keys, item, before.alias("lo"),
        F.when(last, F.lit(2.0)).otherwise(F.col("_hi")).alias("hi"),
    ).filter(F.col("lo") < F.col("hi"))


def _pick(rows: DataFrame, intervals: DataFrame, keys: list[str], item: str, u: str, name: str) -> DataFrame:
    """Interval lookup as an equi-join: intervals are cut into grid cells.

    Uniform numbers spread evenly over the cells, so no cell is hot.
    """
    top = F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int")
    cut = intervals.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("int"), top))
    ).select(*keys, F.col(item).alias(name), "lo", "hi", "_cell")
    placed = rows.withColumn("_cell", F.floor(F.col(u) * CELLS).cast("int"))
    return placed.join(cut, [*keys, "_cell"]).filter(
        (F.col("lo") <= F.col(u)) & (F.col(u) < F.col("hi"))
    ).drop("lo", "hi", "_cell")


def battle_pairs(
    prompts: DataFrame, models: DataFrame, key: str, seed: int = 17,
) -> DataFrame:
    """A weighted pair of models for every prompt, sides swapped at random.

    ``models(model, weight, outage, boost, anonymous, strict ARRAY, targets
    ARRAY)``, where ``strict`` holds name parts a rival must contain and
    ``targets`` preferred rivals, whose weight becomes
    ``0.5 * total / number of targets``. Anonymous models do not meet. The only
    model of a pool meets itself. Rivals are weighed per pair of models; the
    prompts may be any number.
    """
    own = F.when(F.col("outage"), F.lit(0.0)).otherwise(F.col("weight"))
    rated = models.withColumn("_rival", own).withColumn(
        "_first", own * F.when(F.col("boost"), F.lit(2.0)).otherwise(F.lit(1.0))
    )
    chosen = _intervals(rated.select("model", "_first"), [], "model", "_first")
    whole = rated.agg(F.sum("_first").alias("total"), F.count(F.lit(1)).alias("models")).first()
    # Rivals lie in blocks and every model visits each block: no row or task holds
    # all models, only the table of weights has a row per two of them.
    blocks = math.ceil(whole["models"] / RIVALS_PER_BLOCK) or 1
    rivals = rated.select(
        F.col("model").alias("rival"), F.col("_rival").alias("r_weight"),
        F.col("anonymous").alias("r_anonymous"), F.col("strict").alias("r_strict"),
        (F.crc32(F.col("model").cast("binary")) % blocks).cast("int").alias("_block"),
    )
    visits = rated.withColumn("_total", F.lit(float(whole["total"] or 0))).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    table = visits.join(rivals, "_block")
    if whole["models"] > 1:
        table = table.filter(F.col("rival") != F.col("model"))

    def fits(name: Column, patterns: Column) -> Column:
        free = F.size(F.coalesce(patterns, F.array().cast("array<string>"))) == 0
        return free | F.exists(patterns, lambda p: name.contains(p))

    allowed = (
        ~(F.col("anonymous") & F.col("r_anonymous"))
        & fits(F.col("rival"), F.col("strict")) & fits(F.col("model"), F.col("r_strict"))
    )
    targeted = F.coalesce(F.array_contains("targets", F.col("rival")), F.lit(False)) & (F.col("r_weight") != 0)
    table = table.withColumn("_ok", allowed).withColumn(
        "_any", F.max(allowed).over(Window.partitionBy("model"))
    ).withColumn(
        "_w",
        F.when(~F.col("_any"), F.lit(1.0))
        .when(targeted, 0.5 * F.col("_total") / F.size("targets"))
        .otherwise(F.col("r_weight")),
    ).filter(F.col("_ok") | ~F.col("_any"))
    rivals = _intervals(table.select("model", "rival", "_w"), ["model"], "rival", "_w")
    rows = prompts.withColumn("_u1", uniform(seed, F.lit("first"), key)).withColumn(
        "_u2", uniform(seed, F.lit("rival"), key)
    ).withColumn("_swap", draw(seed, F.lit("swap"), key) % 2)
    rows = _pick(rows, chosen, [], "model", "_u1", "_first")
    rows = _pick(
        rows, rivals.withColumnRenamed("model", "_first"), ["_first"], "rival", "_u2", "_second"
    )
    straight = F.col("_swap") == 0
    return rows.withColumn("model_a", F.when(straight, F.col("_first")).otherwise(F.col("_second"))).withColumn(
        "model_b", F.when(straight, F.col("_second")).otherwise(F.col("_first"))
    ).select(*prompts.columns, "model_a", "model_b")


# ---------------------------------------------------------------- seed samples

def seed_samples(
    requests: DataFrame, seeds: DataFrame, k: int = 2, seed: int = 17
) -> DataFrame:
    """k distinct seeds of the request's category for every request.

    ``requests(category, request)``, ``seeds(category, seed_no, uid,
    instruction)`` with ``seed_no`` unique. Slot i takes the seed at the place
    where a permutation keyed by (category, request) puts i, so the slots of a
    request need no memory of one another; a category with fewer seeds fills
    fewer slots. The places meet the seeds by an equi-join on (category,
    position): k rows per request, whatever the size of a category.
    """
    indexed = dense_index(seeds, ["category"], "seed_no", "position", "size")
    sizes = indexed.groupBy("category").agg(F.max("size").alias("size"))
    # A category may hold a third of the requests and few seeds: the small sides
    # are broadcast where their size allows.
    rows = requests.join(broadcast_if_small(sizes), "category")
    rows = rows.select(
        "category", "request", "size", draw(seed, "category", "request").alias("_key"),
        F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"),
    ).filter(F.col("slot") < F.col("size"))
    place = shuffled_position(F.col("slot").cast("bigint"), F.col("size"), F.col("_key"))
    rows = rows.select("category", "request", "slot", place.alias("position"))
    chosen = indexed.select("category", "position", F.col("uid").alias("seed_uid"), "instruction")
    return rows.join(broadcast_if_small(chosen), ["category", "position"]).drop("position")


def seed_prompts(samples: DataFrame, template: str) -> DataFrame:
    """Prompt per request from its few samples, in draw order."""
    listed = F.array_sort(F.collect_list(F.struct("slot", "seed_uid", "instruction")))
    lines = F.transform(
        listed,
        lambda s: F.concat(F.lit("[Question "), (s["slot"] + 1).cast("string"), F.lit("]: "), s["instruction"], F.lit("\n\n")),
    )
    return samples.groupBy("category", "request").agg(
        F.replace(F.lit(template), F.lit("{SAMPLE_QUESTIONS}"), F.array_join(lines, "")).alias("prompt"),
        F.transform(listed, lambda s: s["seed_uid"]).alias("source_seeds"),
    )
