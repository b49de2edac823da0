"""Ratings: ordered online Elo, Bradley-Terry, Rao-Kupper and their bootstraps."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from verdictframe.functions import pairfit
from verdictframe.functions.draws import POISSON, dense_index, mix, mixed, salts, words
from verdictframe.functions.predicates import a_score
from verdictframe.operators.battles import pair_outcomes
from verdictframe.session import scratch_path, truncate

# Rating scale.
K_FACTOR, SCALE, BASE, INIT = 4.0, 400.0, 10.0, 1000.0
# Resamples that one task folds together: at least MIN_WIDTH, else WIDTH_BY_ROOT by the root of the battles; bytes of their
# draws held at once; steps planned, battles hashed and battles folded at once.
MIN_WIDTH, WIDTH_BY_ROOT, SLICE_BYTES = 32, 240_000, 128 << 20
STEPS_AT_ONCE, HASHED_ROWS, FOLD_ROWS = 1024, 1 << 16, 1 << 14


# ---------------------------------------------------------------- online Elo

class Battles:
    """Battles of one key as they arrive in pieces, 24 bytes a row: order, numbers of both models, score."""

    def __init__(self, order: str):
        self.order, self.number = order, {}
        self.parts: list[tuple[np.ndarray, ...]] = []

    def _numbers(self, names: pd.Series) -> np.ndarray:
        """Numbers of the models; -1 without a name."""
        codes, found = pd.factorize(names)
        known = [self.number.setdefault(m, len(self.number)) for m in found]
        return np.array([*known, -1], dtype=np.int32)[codes]

    def add(self, rows: pd.DataFrame) -> None:
        if len(rows):
            columns = (rows[self.order].to_numpy(), self._numbers(rows["model_a"]), self._numbers(rows["model_b"]))
            self.parts.append((*columns, rows["score"].to_numpy(dtype=float)))

    def fold(self, state: dict[str, list], k, scale, base, init) -> set[str]:
        """Apply the battles in order to ``state[model] = [rating, seen as model_a]``; the models that took part."""
        if not self.parts:
            return set()
        order, left, right, score = (np.concatenate(c) for c in zip(*self.parts))
        self.parts = []
        at = pd.Series(order).sort_values(kind="stable").index.to_numpy()
        left, right, score = left[at], right[at], score[at]
        del order, at
        names = list(self.number)
        rating = [state[m][0] if m in state else init for m in names]
        on_left = set(np.unique(left).tolist())
        if -1 in on_left or (right < 0).any():  # a nameless model is the one that appears last
            _, first = np.unique(np.concatenate([left, right]), return_index=True)
            seen = np.concatenate([left, right])[np.sort(first)]
            last = seen[seen >= 0][-1]
            left, right = np.where(left < 0, last, left), np.where(right < 0, last, right)
        for low in range(0, len(left), FOLD_ROWS):
            part = slice(low, low + FOLD_ROWS)
            for a, b, won in zip(left[part].tolist(), right[part].tolist(), score[part].tolist()):
                ra, rb = rating[a], rating[b]
                expected_a = 1 / (1 + base ** ((rb - ra) / scale))
                expected_b = 1 / (1 + base ** ((ra - rb) / scale))
                # Added one after the other: a model may meet itself.
                rating[a] += k * (won - expected_a)
                rating[b] += k * (1 - won - expected_b)
        for i, m in enumerate(names):
            state[m] = [rating[i], (m in state and state[m][1]) or i in on_left]
        return set(names)


def online_elo(
    battles: DataFrame,
    keys: list[str],
    order: str = "seq",
    outcome: str = "vote",
    k: float = K_FACTOR,
    scale: float = SCALE,
    base: float = BASE,
    init: float = INIT,
    rows_per_chunk: int = 2_000_000,
    start: DataFrame | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Elo after all battles of each key, applied in ``order`` (must be unique).

    ``start`` continues from an earlier result; keys without new battles keep it.
    ``largest`` is the row count of the largest key, counted when not given.

    The update is a strict recurrence, so one key cannot be split in parallel.
    It is split in *time* instead: battle n of a key belongs to chunk
    ``n div rows_per_chunk``, and wave c folds chunk c of every key at once,
    starting from the small rating table of wave c-1. No task holds more than
    ``rows_per_chunk`` battles of a key, at 24 bytes each, whatever the order of the keys in time;
    a lost executor repeats one chunk. Keys (systems, bootstrap replicates) run
    in parallel within a wave.
    """
    schema = T.StructType(
        [battles.schema[key] for key in keys]
        + [
            T.StructField("model", T.StringType()),
            T.StructField("rating", T.DoubleType()),
            T.StructField("seen_as_a", T.BooleanType()),
        ]
    )
    slim = battles.select(*keys, order, "model_a", "model_b", a_score(outcome).alias("score"))

    def run(key: tuple, pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict[str, list] = {}
        rows = Battles(order)
        for piece in pieces:
            known = piece["_seen"].notna()
            for m, r, seen in zip(*(piece.loc[known, c] for c in ("model_a", "score", "_seen"))):
                state[m] = [r, bool(seen)]
            rows.add(piece[~known] if known.any() else piece)
        rows.fold(state, k, scale, base, init)
        yield pd.DataFrame([(*key, m, v[0], v[1]) for m, v in state.items()], columns=schema.names)

    # Ratings so far come as rows of their own; whole numbers stay whole without nulls in the order.
    start_order = F.lit(0 if isinstance(battles.schema[order].dataType, T.IntegralType) else None).cast(battles.schema[order].dataType)

    if largest is None:
        largest = largest_group(battles, keys)
    chunks = max(1, math.ceil(largest / rows_per_chunk))

    def wave(part: DataFrame, state: DataFrame | None) -> DataFrame:
        rows = part.withColumn("_seen", F.lit(None).cast("boolean"))
        if state is not None:
            rows = rows.unionByName(state.select(
                *keys, start_order.alias(order), F.col("model").alias("model_a"), F.lit(None).cast("string").alias("model_b"),
                F.col("rating").alias("score"), F.col("seen_as_a").alias("_seen"),
            ))
        return rows.groupBy(*keys).applyInPandas(run, schema)

    if chunks == 1:
        return wave(slim, start)
    # One folder per chunk: a wave reads its own rows only.
    spark = battles.sparkSession
    folder = scratch_path(spark, "elo-chunks")
    marked = dense_index(slim, keys, order, "_place", rows_per_bucket=rows_per_chunk)
    marked = marked.withColumn("chunk", F.floor(F.col("_place") / rows_per_chunk).cast("int")).drop("_place")
    marked.repartition("chunk", *keys).write.partitionBy("chunk").parquet(folder)
    state = start
    for c in range(chunks):
        part = spark.read.schema(slim.schema).parquet(f"{folder}/chunk={c}")
        state = truncate(wave(part, state))
    return state


def largest_group(battles: DataFrame, keys: list[str]) -> int:
    return battles.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def anchored(ratings: DataFrame, keys: list[str], model: str, value: float) -> DataFrame:
    """Shift ratings so ``model`` has ``value``, for models seen on the left.

    Keys without the anchor model stay as they are.
    """
    gap = F.when(F.col("model") == model, F.lit(value) - F.col("rating"))
    shift = F.coalesce(F.max(gap).over(Window.partitionBy(*keys)), F.lit(0.0))
    return ratings.withColumn(
        "rating", F.col("rating") + F.when(F.col("seen_as_a"), shift).otherwise(F.lit(0.0))
    )


def _identity(battles: DataFrame, order: str) -> Column:
    """The number that a battle's draws hang on: its order, hashed where that is no integer."""
    if isinstance(battles.schema[order].dataType, T.IntegralType):
        return F.col(order).cast("bigint")
    return F.xxhash64(order)


def _slice_draws(word: np.ndarray, replicate: int, seed: int, first: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`draws.hashed_copies` with the high half of the sort key in [first, stop): (row number, sort key), by rows."""
    one, two = salts(seed, 2)
    h = mixed(word + np.uint32(mix(replicate ^ one)))
    g = mixed(word + np.uint32(mix(replicate ^ two)))
    row, rows, highs, lows, copy = None, [], [], [], 0
    while len(h):
        # The place in time first: few rows are left of it.
        high = mixed(g + np.uint32(copy + 1))
        high >>= np.uint32(1)
        drawn = h >= np.uint32(POISSON[copy])
        inside = np.flatnonzero(drawn & (high - np.uint32(first) < np.uint32(stop - first)))
        rows.append(inside if row is None else row[inside])
        highs.append(high[inside])
        lows.append(mixed(h[inside] ^ np.uint32(mix(copy + 1))))
        copy += 1
        if copy == len(POISSON):
            break
        left = np.flatnonzero(h >= np.uint32(POISSON[copy]))
        row, h, g = left if row is None else row[left], h[left], g[left]
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    key = np.concatenate(highs).astype(np.uint64) << np.uint64(32)
    key |= np.concatenate(lows)
    return np.concatenate(rows), key


def _block_picks(
    pieces: list[tuple[np.ndarray, np.ndarray]], replicates: range, seed: int, first: int, stop: int, met: np.ndarray
) -> list[np.ndarray]:
    """Cells of the battles in the order of each resample, of the copies whose sort key's high half is in [first, stop).

    ``pieces`` are the hash words and the cells of the battles in their order; ``met[resample, cell]`` marks what was drawn.
    """
    picks, kind = [], pieces[0][1].dtype
    bits = np.uint64(int(met.shape[1]).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    for i, r in enumerate(replicates):
        packed = []
        for word, cell in pieces:
            row, key = _slice_draws(word, r, seed, first, stop)
            # The cell takes the place of the key's last bits: one sort of numbers gives the cells in order.
            key <<= np.uint64(1)
            key &= ~mask
            key |= cell[row]
            packed.append(key)
        packed = np.concatenate(packed)
        packed.sort()
        ends = packed >> bits
        if (ends[1:] == ends[:-1]).any():  # decided by the last bits, and at equal keys by the battles' own order
            del packed, ends
            keys, cells = [], []
            for word, cell in pieces:
                row, key = _slice_draws(word, r, seed, first, stop)
                keys.append(key)
                cells.append(cell[row])
            picks.append(np.concatenate(cells)[np.argsort(np.concatenate(keys), kind="stable")])
        else:
            packed &= mask
            picks.append(packed.astype(kind))
        met[i, picks[-1]] = True
    return picks


def _fold_block(pair: np.ndarray, won: np.ndarray, picks: list[np.ndarray], rating: np.ndarray, places: int, k, scale, base) -> None:
    """Elo of several resamples, one battle of each per step, applied to ``rating`` (resamples x places, flat).

    ``pair`` holds the places of both models for each cell, ``won`` K times the first one's score; the last cell ends
    shorter resamples. One side of a battle gains what the other one loses.
    """
    width, slope, fill = len(picks), math.log(base) / scale, len(won) - 1
    at, gap = np.arange(width) * places, np.empty(width)
    rating *= slope  # so that a step saves a product
    for low in range(0, max(map(len, picks)), STEPS_AT_ONCE):
        steps = min(STEPS_AT_ONCE, max(map(len, picks)) - low)
        plan = np.full((steps, width), fill, dtype=np.int64)
        for i, pick in enumerate(picks):
            part = pick[low : low + steps]
            plan[: len(part), i] = part
        for where, gain in zip((pair[:, plan] + at).swapaxes(0, 1), won[plan] * slope):
            own = rating[where]
            left, right = own
            np.subtract(right, left, out=gap)
            np.exp(gap, out=gap)
            np.add(gap, 1, out=gap)
            np.divide(k * slope, gap, out=gap)
            np.subtract(gain, gap, out=gap)
            left += gap
            right -= gap
            rating[where] = own
    rating /= slope


def packed_battles(battles: DataFrame, keys: list[str], order: str, outcome: str) -> DataFrame:
    """The battles in stored pieces of one Arrow batch: six bytes a battle, and the list of the piece's cells.

    A battle is the word its draws hang on and its cell, one number for (model, model, score). ``_part`` and ``_piece``
    number the pieces in the order of the battles.
    """
    slim = battles.select(
        *keys, F.col("model_a").cast("string").alias("model_a"), F.col("model_b").cast("string").alias("model_b"),
        a_score(outcome).cast("double").alias("score"), F.coalesce(_identity(battles, order), F.lit(-(1 << 63))).alias("_id"),
    )
    rows = slim.repartitionByRange(*keys, "_id").sortWithinPartitions(*keys, "_id", "model_a", "model_b", "score")
    rows = rows.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([battles.schema[key] for key in keys] + [
        T.StructField("_part", T.IntegerType()), T.StructField("_piece", T.IntegerType()),
        T.StructField("words", T.BinaryType()), T.StructField("cells", T.BinaryType()),
        T.StructField("left", T.ArrayType(T.StringType())), T.StructField("right", T.ArrayType(T.StringType())),
        T.StructField("score", T.ArrayType(T.DoubleType())),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = np.zeros(batch.num_rows - 1, dtype=bool)
            for key in keys:
                value = np.array([*batch.column(key).to_pylist(), None], dtype=object)[:-1]
                cut |= value[1:] != value[:-1]
            starts = [0, *(np.flatnonzero(cut) + 1).tolist()]
            columns = {name: [] for name in schema.names[len(keys) :]}
            for first, stop in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(first, stop - first)
                cells: dict[tuple, int] = {}
                codes = [cells.setdefault(c, len(cells)) for c in zip(*(part.column(c).to_pylist() for c in ("model_a", "model_b", "score")))]
                left, right, score = (list(c) for c in zip(*cells))
                word = words(part.column("_id").to_numpy(zero_copy_only=False))
                code = np.array(codes, dtype=np.uint16 if len(cells) < 1 << 16 else np.uint32)
                values = (part.column("_part")[0].as_py(), number, word.tobytes(), code.tobytes(), left, right, score)
                for column, value in zip(columns.values(), values):
                    column.append(value)
                number += 1
            at = pa.array(starts)
            made = [batch.column(key).take(at) for key in keys]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64()))
            made += [pa.array(column, type=kind) for column, kind in zip(columns.values(), kinds)]
            yield pa.RecordBatch.from_arrays(made, names=schema.names)

    return truncate(rows.mapInArrow(pack, schema))


class Packed:
    """The packed battles of one key as they arrive: words and cells in pieces, cells numbered over all pieces."""

    def __init__(self):
        self.cells: dict[tuple, int] = {}
        self.pieces: list[tuple] = []

    def add(self, row: dict) -> None:
        known = [self.cells.setdefault(c, len(self.cells)) for c in zip(row["left"], row["right"], row["score"])]
        word = np.frombuffer(row["words"], dtype=np.uint32).copy()
        code = np.frombuffer(row["cells"], dtype=np.uint16 if len(row["cells"]) == 2 * len(word) else np.uint32)
        cell = np.array(known, dtype=np.uint16 if len(self.cells) < 1 << 16 else np.uint32)[code]
        self.pieces.append((row["_part"], row["_piece"], word, cell))

    def ordered(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pieces of about ``HASHED_ROWS`` battles in the order of the battles."""
        kind = np.uint16 if len(self.cells) < 1 << 16 else np.uint32
        self.pieces.sort(key=lambda p: p[:2], reverse=True)
        out, some, rows = [], [], 0
        while self.pieces:
            some.append(self.pieces.pop()[2:])
            rows += len(some[-1][0])
            if rows >= HASHED_ROWS or not self.pieces:
                word, cell = (np.concatenate(c) for c in zip(*some))
                out.append((word, cell.astype(kind, copy=False)))
                some, rows = [], 0
        return out


def resampled_elo(
    battles: DataFrame, keys: list[str], order: str, rounds: int, seed: int, largest: int,
    outcome: str = "vote", k: float = K_FACTOR, scale: float = SCALE, base: float = BASE,
    init: float = INIT, rows_per_chunk: int = 2_000_000, rows_per_block: int = 2_000_000,
) -> DataFrame:
    """Online Elo of every Poisson resample: (keys, replicate, model, rating).

    The battles are packed once, six bytes each, see :func:`packed_battles`. The packed pieces travel once per *block* of
    resamples, which draws, sorts and folds them together; no copy is ever written out. Beyond
    ``rows_per_block`` battles, or ``SLICE_BYTES`` of draws, a block takes its draws in slices of sort keys, that is of time
    in the resamples, of at most about ``rows_per_chunk`` draws each, and hashes the battles again for each slice: a task
    holds 6 bytes per battle of a key and the cells of one slice.
    """
    # A step costs about the same for few resamples as for many, but wide blocks of many battles need more slices, so more
    # hashing. Blocks come in whole rounds of the cores.
    spark = battles.sparkSession
    cores = spark.sparkContext.defaultParallelism
    width = max(MIN_WIDTH, int(WIDTH_BY_ROOT / math.sqrt(max(largest, 1))))
    turns = math.ceil(math.ceil(rounds / width) / cores)
    width = max(MIN_WIDTH // 2, math.ceil(rounds / (turns * cores)))
    schema = T.StructType([battles.schema[key] for key in keys] + [
        T.StructField("replicate", T.IntegerType()), T.StructField("model", T.StringType()),
        T.StructField("rating", T.DoubleType()),
    ])
    key_kinds = to_arrow_schema(T.StructType([battles.schema[key] for key in keys]))

    def folded(group: tuple, block: int, rows: Packed) -> pa.RecordBatch:
        pieces = rows.ordered()
        replicates = range(block * width, min((block + 1) * width, rounds))
        left, right, score = (np.array(c, dtype=t) for c, t in zip(zip(*rows.cells), (object, object, float)))
        codes, models = pd.factorize(np.concatenate([left, right]))
        left, right = codes[: len(left)], codes[len(left) :]
        # A spare cell ends shorter resamples, and so does a model that meets itself: its two changes cancel.
        count, spare, alone = len(rows.cells), len(models), left == right
        pair = np.array([np.append(np.where(alone, spare, left), spare), np.append(np.where(alone, spare + 1, right), spare + 1)])
        won = k * np.append(score, 0.5)
        places, seen = spare + 2, np.zeros((len(replicates), count + 1), dtype=bool)
        rating = np.full(len(replicates) * places, float(init))
        size = sum(len(word) for word, _ in pieces)
        slices = max(1, math.ceil(size * len(replicates) * pieces[0][1].itemsize / SLICE_BYTES))
        if size > rows_per_block:
            slices = max(slices, math.ceil(size / rows_per_chunk))
        edges = [(1 << 31) * i // slices for i in range(slices + 1)]
        for first, stop in zip(edges, edges[1:]):
            picks = _block_picks(pieces, replicates, seed, first, stop, seen)
            _fold_block(pair, won, picks, rating, places, k, scale, base)
            del picks
        met = np.zeros((len(replicates), spare), dtype=bool)
        for side in (left, right):
            for c, m in enumerate(side):
                met[:, m] |= seen[:, c]
        which, model = np.nonzero(met)
        made = [pa.array([value] * len(which), type=kind) for value, kind in zip(group, key_kinds.types)]
        made += [
            pa.array(np.array(replicates, dtype=np.int32)[which]), pa.array(np.asarray(models, dtype=object)[model], type=pa.string()),
            pa.array(rating.reshape(-1, places)[which, model]),
        ]
        return pa.RecordBatch.from_arrays(made, names=schema.names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of a block and key follow one another."""
        group, block, rows = None, 0, Packed()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                key = tuple(row[name] for name in keys)
                if rows.pieces and (key, row["_block"]) != (group, block):
                    yield folded(group, block, rows)
                    rows = Packed()
                group, block = key, row["_block"]
                rows.add(row)
            del batch
        if rows.pieces:
            yield folded(group, block, rows)

    blocks = math.ceil(rounds / width)
    pieces = packed_battles(battles, keys, order, outcome)
    each = pieces.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Far more parts than blocks: two blocks seldom share a task, and small rows are not put together again.
    each = each.repartition(min(16 * blocks, 2_000), *keys, "_block").sortWithinPartitions("_block", *keys)
    return each.mapInArrow(fold, schema)


def bootstrap_bounds(replicates: DataFrame, keys: list[str], rounds: int, level: float = 0.9) -> DataFrame:
    """Order-statistic bounds at positions int(a R) and int((1-a) R).

    A model missing from some replicates is indexed over the ones it is in; the
    count tells how many those are. At most ``rounds`` numbers per model.
    """
    alpha = (1 - level) / 2
    low, high = int(alpha * rounds), int((1 - alpha) * rounds)
    rows = F.array_sort(F.collect_list("rating"))

    def pick(position: int) -> Column:
        return F.element_at("_r", F.least(F.lit(position), F.size("_r") - 1) + 1)

    grouped = replicates.groupBy(*keys, "model").agg(rows.alias("_r"))
    return grouped.select(
        *keys, "model",
        pick(low).alias("lower_bound"), pick(high).alias("upper_bound"),
        F.size("_r").cast("bigint").alias("replicates"),
    )


def elo_with_intervals(
    battles: DataFrame, keys: list[str], order: str = "seq", rounds: int = 1000,
    level: float = 0.9, seed: int = 17, **elo,
) -> DataFrame:
    """Online Elo with bootstrap bounds and their deltas to the rating."""
    largest = largest_group(battles, keys)
    point = online_elo(battles, keys, order, largest=largest, **elo).select(*keys, "model", "rating")
    repeats = resampled_elo(battles, keys, order, rounds, seed, largest, **elo)
    bounds = bootstrap_bounds(repeats, keys, rounds, level)
    return point.join(bounds, [*keys, "model"]).withColumn(
        "ci_low", F.col("lower_bound") - F.col("rating")
    ).withColumn("ci_high", F.col("upper_bound") - F.col("rating"))


# ------------------------------------------------- fits on pair outcome counts

def _codes(pairs: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    models = sorted(set(pairs["model_a"]) | set(pairs["model_b"]))
    at = {m: i for i, m in enumerate(models)}
    left = pairs["model_a"].map(at).to_numpy(dtype=np.int64)
    right = pairs["model_b"].map(at).to_numpy(dtype=np.int64)
    return models, left, right


def _legacy_ties(pairs: pd.DataFrame) -> pd.DataFrame:
    """Ties of the later orientation of a pair replace those of the earlier."""
    pairs = pairs.sort_values(["model_a", "model_b"]).copy()
    last: dict[tuple, float] = {}
    owner: dict[tuple, int] = {}
    for i, (a, b, tie) in enumerate(zip(pairs["model_a"], pairs["model_b"], pairs["tie"])):
        if tie > 0:
            last[tuple(sorted((a, b)))] = tie
            owner[tuple(sorted((a, b)))] = i
    ties = np.zeros(len(pairs))
    for pair, i in owner.items():
        ties[i] = last[pair]
    return pairs.assign(tie=ties)


def bradley_terry_fit(pairs: pd.DataFrame, legacy_ties: bool = False) -> pd.DataFrame:
    """Strengths from outcome counts; a tie is half a win for either side.

    Self-pairs carry no information. Without both outcomes all stay at 0.
    """
    models, _, _ = _codes(pairs)
    used = pairs[pairs["model_a"] != pairs["model_b"]]
    if legacy_ties:
        used = _legacy_ties(used)
    at = {m: i for i, m in enumerate(models)}
    left = used["model_a"].map(at).to_numpy(dtype=np.int64)
    right = used["model_b"].map(at).to_numpy(dtype=np.int64)
    half = used["tie"].to_numpy(dtype=float) / 2
    a_win = used["a_win"].to_numpy(dtype=float) + half
    b_win = used["b_win"].to_numpy(dtype=float) + half
    if a_win.sum() == 0 or b_win.sum() == 0:
        coef, converged = np.zeros(len(models)), True
    else:
        coef, converged = pairfit.fit_bradley_terry(left, right, a_win, b_win, len(models))
    return pd.DataFrame({"model": models, "coef": coef, "eta": None, "converged": converged})


def rao_kupper_fit(pairs: pd.DataFrame) -> pd.DataFrame:
    """Strengths and a tie parameter from outcome counts."""
    pairs = pairs[pairs["model_a"] != pairs["model_b"]]
    models, left, right = _codes(pairs)
    counts = [pairs[c].to_numpy(dtype=float) for c in ("a_win", "b_win", "tie")]
    coef, eta, converged = pairfit.fit_rao_kupper(left, right, *counts, len(models))
    return pd.DataFrame({"model": models, "coef": coef, "eta": eta, "converged": converged})


# Rating functions by name; register your own to plug into the jobs below.
RATING_FUNCTIONS: dict[str, Callable[..., pd.DataFrame]] = {
    "bt": bradley_terry_fit,
    "rk": rao_kupper_fit,
}


def register_rating_function(name: str, fit: Callable[..., pd.DataFrame]) -> None:
    RATING_FUNCTIONS[name] = fit


FIT_FIELDS = [
    T.StructField("model", T.StringType()),
    T.StructField("coef", T.DoubleType()),
    T.StructField("eta", T.DoubleType()),
    T.StructField("converged", T.BooleanType()),
    T.StructField("battles", T.LongType()),
]


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [df.schema[key] for key in keys]


def fit_pairs(counts: DataFrame, keys: list[str], method: str = "bt", **options) -> DataFrame:
    """One fit per key on the pair counts.

    A group has one row per ordered model pair, whatever the battle count.
    ``rating = 400 coef + 1000`` with coef in natural-log units.
    """
    fit = RATING_FUNCTIONS[method]

    def run(key: tuple, pairs: pd.DataFrame) -> pd.DataFrame:
        out = fit(pairs, **options)
        out["battles"] = int(pairs[["a_win", "b_win", "tie"]].to_numpy().sum())
        for name, value in zip(reversed(keys), reversed(key)):
            out.insert(0, name, value)
        return out

    schema = T.StructType(_key_fields(counts, keys) + FIT_FIELDS)
    return counts.groupBy(*keys).applyInPandas(run, schema).withColumn(
        "rating", SCALE * F.col("coef") + INIT
    )


def bootstrap_fits(
    counts: DataFrame, keys: list[str], rounds: int = 100, seed: int = 17,
    method: str = "bt", **options,
) -> DataFrame:
    """One fit per key and replicate.

    A resample of the battles is a multinomial draw over the outcome counts, so
    the data is aggregated once and a replicate moves only models^2 numbers.
    """
    fit = RATING_FUNCTIONS[method]

    def run(key: tuple, pairs: pd.DataFrame) -> pd.DataFrame:
        # The replicate is part of the group key, so replicates spread over tasks.
        replicate = int(key[-1])
        rng = np.random.default_rng([seed, replicate, *"\x1f".join(map(str, key[:-1])).encode()])
        pairs = pairs.sort_values(["model_a", "model_b"]).reset_index(drop=True)
        cells = pairs[["a_win", "b_win", "tie"]].to_numpy(dtype=np.int64)
        total = cells.sum()
        picked = rng.multinomial(total, (cells / total).ravel()).reshape(cells.shape)
        sample = pairs.assign(a_win=picked[:, 0], b_win=picked[:, 1], tie=picked[:, 2])
        out = fit(sample[picked.sum(axis=1) > 0], **options)
        out["battles"] = int(total)
        for name, value in zip(reversed([*keys, "replicate"]), reversed(key)):
            out.insert(0, name, value)
        return out

    spread = counts.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    schema = T.StructType(
        _key_fields(counts, keys) + [T.StructField("replicate", T.IntegerType())] + FIT_FIELDS
    )
    return spread.groupBy(*keys, "replicate").applyInPandas(run, schema).withColumn(
        "rating", SCALE * F.col("coef") + INIT
    )


def bradley_terry_with_margin(
    battles: DataFrame, keys: list[str], rounds: int = 100, seed: int = 17,
    outcome: str = "vote", legacy_ties: bool = False,
) -> DataFrame:
    """Bradley-Terry ratings with half the 95% bootstrap range as margin.

    Fewer than 2 battles leave every rating at its start, fewer than 10 give
    no interval.
    """
    counts = pair_outcomes(battles, keys, outcome)
    point = fit_pairs(counts, keys, "bt", legacy_ties=legacy_ties)
    repeats = bootstrap_fits(counts, keys, rounds, seed, "bt", legacy_ties=legacy_ties)
    spread = repeats.groupBy(*keys, "model").agg(
        F.percentile("rating", F.lit(0.025)).alias("lo"),
        F.percentile("rating", F.lit(0.975)).alias("hi"),
    )
    joined = point.join(spread, [*keys, "model"], "left")
    return joined.select(
        *keys, "model",
        F.when(F.col("battles") < 2, F.lit(INIT)).otherwise(F.col("rating")).alias("rating"),
        F.when(F.col("battles") < 10, F.lit(0.0)).otherwise(
            F.coalesce((F.col("hi") - F.col("lo")) / 2, F.lit(0.0))
        ).alias("margin"),
        "converged", "battles",
    )


# ------------------------------------------------- contrasts and probabilities

def baseline_contrast(items: DataFrame, row: str, item: str, baseline: str) -> DataFrame:
    """Sparse design rows: +1 at the item, -1 at the baseline.

    The baseline's own row holds a single -1.
    """
    entry = F.when(
        F.col(item) == baseline,
        F.array(F.struct(F.lit(baseline).alias("feature"), F.lit(-1).alias("value"))),
    ).otherwise(
        F.array(
            F.struct(F.col(item).alias("feature"), F.lit(1).alias("value")),
            F.struct(F.lit(baseline).alias("feature"), F.lit(-1).alias("value")),
        )
    )
    return items.select(row, F.explode(entry).alias("e")).select(row, "e.*")


def win_probability(coefs: DataFrame, keys: list[str], baseline: str, coef: str = "coef") -> DataFrame:
    """Chance of each model to beat the baseline, e^c / (e^c + e^c0)."""
    base = F.max(F.when(F.col("model") == baseline, F.col(coef))).over(Window.partitionBy(*keys))
    return coefs.withColumn("win_probability", 1 / (1 + F.exp(base - F.col(coef))))


# -------------------------------------------------- regularised binary outcome

def fit_binary(rows: DataFrame, features: list[str], outcome: str, weight: str | None = None):
    """L2 logistic fit with intercept; the penalty is the usual C = 1.

    The objective sums losses plus half the squared norm, so MLlib's averaged
    form needs ``regParam = 1 / total weight``.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    total = rows.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0]
    model = LogisticRegression(
        featuresCol="_features", labelCol=outcome, regParam=1.0 / float(total),
        elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-10,
    )
    if weight:
        model = model.setWeightCol(weight)
    packed = VectorAssembler(inputCols=features, outputCol="_features").transform(rows)
    return model.fit(packed)


def binary_cells(rows: DataFrame, features: list[str], outcome: str) -> DataFrame:
    """Equal feature rows become one weighted row; the loss does not change."""
    return rows.groupBy(*features, outcome).agg(F.count(F.lit(1)).alias("weight"))


def _cell_draws(cells: pd.DataFrame, rounds: int, seed: int) -> np.ndarray:
    """How often each cell is drawn in each replicate: Poisson with the cell's count as mean.

    The generator is seeded by the cell's own key, so the draws do not depend on
    how the cells are spread over tasks.
    """
    out = np.empty((len(cells), rounds))
    for row, (key, count) in enumerate(zip(cells["_key"].tolist(), cells["weight"].tolist())):
        out[row] = np.random.Generator(np.random.PCG64([seed, key & (2**64 - 1)])).poisson(count, rounds)
    return out


def bootstrap_binary(
    rows: DataFrame, features: list[str], outcome: str, rounds: int = 100, seed: int = 17,
    steps: int = 100,
) -> DataFrame:
    """Coefficients per replicate, intercept included.

    Equal feature rows become one weighted cell, drawn Poisson(weight) times in
    each replicate. All replicates are fitted together: in a Newton step every
    task adds up gradients and Hessians of its cells for all of them, the sums
    (replicates x features^2 numbers) are combined, and the small systems solved.
    One way for every size; no task holds a replicate.
    """
    names = [*features, "intercept"]
    cells = truncate(
        binary_cells(rows, features, outcome).withColumn("_key", F.xxhash64(*features, outcome))
    )
    size = len(names)
    beta = np.zeros((rounds, size))
    penalty = np.append(np.ones(len(features)), 0.0)

    def sums(at: np.ndarray):
        def run(batches):
            grad, info = np.zeros((rounds, size)), np.zeros((rounds, size, size))
            for part in batches:
                x = np.column_stack([part[features].to_numpy(dtype=float), np.ones(len(part))])
                y = part[outcome].to_numpy(dtype=float)[:, None]
                w = _cell_draws(part, rounds, seed)
                p = pairfit.sigmoid(x @ at.T)
                grad += (w * (y - p)).T @ x
                info += np.einsum("nr,ni,nj->rij", w * p * (1 - p), x, x, optimize=True)
            flat = np.concatenate([grad, info.reshape(rounds, -1)], axis=1)
            yield pd.DataFrame({
                "replicate": np.repeat(np.arange(rounds), flat.shape[1]),
                "place": np.tile(np.arange(flat.shape[1]), rounds), "value": flat.ravel(),
            })

        return run

    for _ in range(steps):
        parts = cells.mapInPandas(sums(beta), "replicate int, place int, value double")
        total = np.zeros((rounds, size + size * size))
        for r in parts.groupBy("replicate", "place").agg(F.sum("value").alias("v")).collect():
            total[r["replicate"], r["place"]] = r["v"]
        grad = total[:, :size] - penalty * beta
        info = total[:, size:].reshape(rounds, size, size) + np.diag(penalty)
        step = np.stack([np.linalg.lstsq(m, g, rcond=None)[0] for m, g in zip(info, grad)])
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return rows.sparkSession.createDataFrame(
        [(r, f, float(v)) for r in range(rounds) for f, v in zip(names, beta[r])],
        "replicate int, feature string, coef double",
    )
