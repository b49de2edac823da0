"""Deterministic draws and dense row positions.

A draw is the first 60 bits of an md5 digest over ``seed:key:...``. Any engine
with md5 reproduces it, a retried task draws the same numbers, and no task
needs a generator state. Where a task draws for many replicates at once the
digest is a 32-bit integer hash on arrays instead (``mix``), as easy to state in SQL.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 60
WORD = 0xFFFFFFFF
# Fixed value: multiplier of the hash; below 2^31, so a product of a word fits 63 bits.
MULTIPLIER = 0x45D9F3B
# Rounds of a permutation, and walks back into its range.
FEISTEL_ROUNDS, WALK = 6, 64
# The distribution function of Poisson(1) in steps of 2^-32, up to its last step.
POISSON = [
    int(2**32 * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(12)
]


def mix(x):
    """Hash of 32-bit words, for one integer or an int64 array."""
    x = ((x ^ (x >> 16)) * MULTIPLIER) & WORD
    x = ((x ^ (x >> 16)) * MULTIPLIER) & WORD
    return x ^ (x >> 16)


def salts(seed: int, count: int) -> list[int]:
    return [mix((seed * 64 + i + 1) & WORD) for i in range(count)]


def poisson_copies(ids: np.ndarray, replicate: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Copies of each row in one resample: (row number, sort key) per copy.

    A row is drawn Poisson(1) times, each copy with a sort key of 63 bits of its
    own; both are functions of (seed, replicate, id) alone.
    """
    return hashed_copies(words(ids), replicate, seed)


def mixed(x: np.ndarray) -> np.ndarray:
    """:func:`mix` of 32-bit words that wrap by themselves; changes its argument."""
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(MULTIPLIER)
    x ^= x >> np.uint32(16)
    return x


def words(ids: np.ndarray) -> np.ndarray:
    """The part of the hash that hangs on the rows alone."""
    ids = ids.astype(np.int64)
    return mixed(mixed(ids.astype(np.uint32)) ^ (ids >> 32).astype(np.uint32))


def hashed_copies(word: np.ndarray, replicate: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`poisson_copies` of rows by their :func:`words`."""
    one, two = salts(seed, 2)
    h = mixed(word + np.uint32(mix(replicate ^ one)))
    rows, copies = [], []
    drawn, copy = np.flatnonzero(h >= np.uint32(POISSON[0])), 0
    while len(drawn):
        rows.append(drawn)
        copies.append(np.full(len(drawn), copy, dtype=np.uint32))
        copy += 1
        drawn = drawn[h[drawn] >= np.uint32(POISSON[copy])] if copy < len(POISSON) else drawn[:0]
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    row, copy = np.concatenate(rows), np.concatenate(copies)
    order = np.argsort(row, kind="stable")
    row, copy = row[order], copy[order]
    copy += np.uint32(1)
    high = mixed(mixed(word[row] + np.uint32(mix(replicate ^ two))) + copy)
    key = ((high >> np.uint32(1)).astype(np.int64) << 32) | mixed(h[row] ^ mixed(copy))
    return row, key


_MD5_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
_MD5_ADDED = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_MD5_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)


def _md5_start(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the digests of padded texts (a byte matrix, 64 bytes a block)."""
    state = [np.full(len(texts), w, dtype=np.uint32) for w in _MD5_START]
    for first in range(0, texts.shape[1], 64):
        word = np.ascontiguousarray(np.ascontiguousarray(texts[:, first : first + 64]).view("<u4").T)
        a, b, c, d = (x.copy() for x in state)
        for i in range(64):
            if i < 16:
                f, at = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, at = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, at = c ^ (b | ~d), 7 * i % 16
            f += a
            f += _MD5_ADDED[i]
            f += word[at]
            turned = f << _MD5_TURNS[i]
            f >>= np.uint32(32) - _MD5_TURNS[i]
            turned |= f
            turned += b
            a, d, c, b = d, c, b, turned
        for x, y in zip(state, (a, b, c, d)):
            x += y
    return state[0], state[1]


def numbered_draws(prefix: str, first: int, stop: int) -> np.ndarray:
    """:func:`draw` of ``prefix:i`` for i from ``first`` to below ``stop``, in one array."""
    head, out = np.frombuffer(f"{prefix}:".encode(), dtype=np.uint8), []
    while first < stop:
        digits = len(str(first))
        numbers = np.arange(first, min(stop, 10**digits), dtype=np.int64)
        size = len(head) + digits
        texts = np.zeros((len(numbers), (size + 8) // 64 * 64 + 64), dtype=np.uint8)
        texts[:, : len(head)] = head
        for place in range(digits):
            texts[:, size - 1 - place] = 48 + numbers // 10**place % 10
        texts[:, size] = 0x80
        texts[:, -8:] = np.frombuffer((8 * size).to_bytes(8, "little"), dtype=np.uint8)
        one, two = (x.byteswap().astype(np.int64) for x in _md5_start(texts))
        out.append((one << (BITS - 32)) | (two >> (64 - BITS)))
        first = min(stop, 10**digits)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def draw(seed: int | str, *keys: Column | str) -> Column:
    parts = [F.lit(str(seed))] + [
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys
    ]
    digest = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("bigint")


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1)."""
    return draw(seed, *keys).cast("double") / F.lit(float(2**BITS))


def range_bucket(df: DataFrame, order: str, buckets: int, name: str = "bucket") -> DataFrame:
    """Monotone bucket number of a numeric column.

    The boundaries come from one approximate-percentile pass, so a bucket holds
    about ``1/buckets`` of the rows whatever the distribution; rows with equal
    values always share a bucket.
    """
    if buckets <= 1:
        return df.withColumn(name, F.lit(0))
    steps = [i / buckets for i in range(1, buckets)]
    bounds = df.agg(F.percentile_approx(order, steps, 20 * buckets).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))
    if not bounds:
        return df.withColumn(name, F.lit(0))
    # One array literal whatever its length, searched by halving.
    cuts = F.from_json(F.lit(json.dumps([float(b) for b in bounds])), "array<double>")
    at, none = F.col(order).cast("double"), F.lit(0).cast("int")

    def halve(span: Column, _: Column) -> Column:
        low, high = span["low"], span["high"]
        middle = F.shiftright(low + high, 1)
        below = (low < high) & (F.get(cuts, middle) < at)
        return F.struct(
            F.when(below, middle + 1).otherwise(low).alias("low"),
            F.when(below | (low >= high), high).otherwise(middle).alias("high"),
        )

    start = F.struct(none.alias("low"), F.lit(len(bounds)).cast("int").alias("high"))
    steps = F.sequence(F.lit(0), F.lit(len(bounds).bit_length()))
    return df.withColumn(name, F.aggregate(steps, start, halve)["low"])


def _mixed(x: Column) -> Column:
    """:func:`mix` of a bigint column; each step names its word once."""
    def shifted(w: Column) -> Column:
        return w.bitwiseXOR(F.shiftright(w, 16))

    def step(w: Column) -> Column:
        return (shifted(w) * F.lit(MULTIPLIER)).bitwiseAND(F.lit(WORD))

    for change in (step, step, shifted):
        x = F.get(F.transform(F.array(x), change), F.lit(0))
    return x


def shuffled_position(index: Column, size: Column, key: Column) -> Column:
    """Where a keyed permutation of 0 .. size - 1 puts ``index``; null where index >= size.

    A Feistel network of ``FEISTEL_ROUNDS`` rounds over the square a x a that just holds
    ``size`` numbers, walked on until it is back among them. A cycle has at most
    a * a - size steps outside, and a larger square is left with certainty for all
    practical purposes (below 10^-70 per row) within ``WALK`` steps. Constant memory,
    distinct positions for distinct indexes. ``key`` and ``size`` are bigint, size below 2^60.
    """
    side = F.ceil(F.sqrt(size.cast("double"))).cast("bigint")

    def turn(pair: Column, number: Column) -> Column:
        word = (key + pair["right"] + number * F.lit(MULTIPLIER)).bitwiseAND(F.lit(WORD))
        return F.struct(
            pair["right"].alias("left"), ((pair["left"] + _mixed(word)) % pair["side"]).alias("right"), pair["side"].alias("side")
        )

    def moved(at: Column) -> Column:
        start = F.struct(F.floor(at / side).cast("bigint").alias("left"), (at % side).alias("right"), side.alias("side"))
        rounds = F.sequence(F.lit(1).cast("bigint"), F.lit(FEISTEL_ROUNDS).cast("bigint"))
        return F.aggregate(rounds, start, turn, lambda pair: pair["left"] * pair["side"] + pair["right"])

    steps = F.sequence(F.lit(1), F.lit(WALK))
    found = F.aggregate(steps, moved(index), lambda at, _: F.when(at >= size, moved(at)).otherwise(at))
    return F.when(index < size, found)


def dense_index(
    df: DataFrame,
    keys: list[str],
    order: str,
    name: str = "idx",
    total: str | None = None,
    rows_per_bucket: int = 2_000_000,
    bucket_by: Column | None = None,
) -> DataFrame:
    """Contiguous 0-based position per key, without one task per key.

    A plain ``row_number`` over a key sorts that whole key in one task. Here rows
    are numbered inside (key, range bucket) and shifted by the size of the
    earlier buckets, a table with one row per key and bucket.
    ``order`` must be unique within a key; where it is not a number (a struct, a
    text), ``bucket_by`` is a number that grows with it, the leading field say.
    """
    rows = df.count()
    buckets = max(1, math.ceil(rows / rows_per_bucket))
    if buckets == 1:
        whole = Window.partitionBy(*keys)
        position = F.row_number().over(whole.orderBy(order)) - 1
        out = df.withColumn(name, position.cast("bigint"))
        return out.withColumn(total, F.count(F.lit(1)).over(whole)) if total else out
    if bucket_by is None:
        marked = range_bucket(df, order, buckets, "_bucket")
    else:
        marked = range_bucket(df.withColumn("_by", bucket_by), "_by", buckets, "_bucket").drop("_by")
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order)
    numbered = marked.withColumn("_pos", F.row_number().over(inner) - 1)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = Window.partitionBy(*keys)
    shifts = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
        F.sum("_n").over(whole).alias("_total"),
    )
    on = [F.col("_bucket") == F.col("_b")]
    on += [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = numbered.join(shifts, on, "left").withColumn(
        name, (F.col("_pos") + F.col("_shift")).cast("bigint")
    )
    if total:
        out = out.withColumn(total, F.col("_total").cast("bigint"))
    return out.select(*df.columns, name, *([total] if total else []))
