"""Log streams, latency statistics and incremental worklists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdictframe.sources.sinks import log_partitions
from verdictframe.streaming.votes import _started, per_batch


def iso(column: Column) -> Column:
    """Timestamp as ISO-8601 text with microseconds."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def serialised_interactions(interactions: Column) -> Column:
    """Turns of interactions with their times as text.

    ``ARRAY<ARRAY<STRUCT<time, action>>>``: one inner array per turn.
    """
    return F.transform(
        interactions,
        lambda turn: F.transform(
            turn, lambda e: F.struct(iso(e["time"]).alias("time"), e["action"].alias("action"))
        ),
    )


def log_name(conv_id: Column, chat_round: Column, sandbox_round: Column) -> Column:
    """File name of a sandbox log."""
    parts = [F.lit("sandbox-logs"), *[c.cast("string") for c in (conv_id, chat_round, sandbox_round)]]
    return F.concat(F.concat_ws("-", *parts), F.lit(".json"))


def write_log_stream(
    logs: DataFrame, path: str, checkpoint: str, start: str = "start", interval: str | None = None
) -> StreamingQuery:
    """Append logs to date and mode folders, exactly once."""
    writer = log_partitions(logs, start).writeStream.format("json").partitionBy(
        "date", "chat_mode"
    ).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    return _started(writer, interval)


def response_records(rows: DataFrame) -> DataFrame:
    """Response records with their stamps at four decimals."""
    return rows.select(
        "model", F.round("start_ts", 4).alias("start_ts"), F.round("end_ts", 4).alias("end_ts")
    )


def latency_stats(responses: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds from start to end: mean, median and 95th percentile.

    Equal times (four decimals) are counted first, so the exact percentiles see
    one row per key and time.
    """
    took = F.round(F.col("end_ts") - F.col("start_ts"), 4)
    cells = responses.groupBy(*keys, took.alias("seconds")).agg(F.count(F.lit(1)).alias("rows"))
    timed = F.col("seconds").isNotNull()
    return cells.groupBy(*keys).agg(
        F.sum("rows").alias("n"),
        (F.sum(F.col("seconds") * F.col("rows")) / F.sum(F.when(timed, F.col("rows")))).alias("mean"),
        F.percentile("seconds", F.lit(0.5), F.col("rows")).alias("p50"),
        F.percentile("seconds", F.lit(0.95), F.col("rows")).alias("p95"),
    )


def taken_once(records: DataFrame, key: str) -> DataFrame:
    """The first arrival of every key of a stream, whatever the number of batches.

    The taken keys are keyed state of the stream: a batch costs its own rows, not
    those of all batches before, and a restart resumes from the checkpoint.
    """
    return records.dropDuplicates([key])


#: Groups of keys whose states are kept together: a call of the fold costs far more than a key of it.
KEY_GROUPS = 1024


def worklist_status(
    events: DataFrame, key: str, retries: int = 2, keep_ms: int = 30 * 24 * 3600 * 1000, state: str = "state",
) -> DataFrame:
    """Status of every key that a trigger touches: (key, status, attempt, take).

    ``events(key, state)`` holds arrivals (any state but the two that follow) and outcomes,
    ``failed`` and ``completed``. A key is ``completed`` once it was completed, ``given_up`` after more
    than ``retries`` failures, else ``open`` with attempt 1 + failures. ``take`` marks the
    triggers that open an attempt no earlier one opened: those rows are the work to do.

    Kept per key: failures, whether completed, the last attempt opened, the time of its last event. They do not depend on
    the order of the events, so pieces of a trigger are counted one after the other and never held together, also where
    one key has most of the rows. Keys are kept in ``KEY_GROUPS`` groups by hash, one table of a row per key each; a trigger
    reads and writes the groups that it touches. A key is forgotten ``keep_ms`` after its last event (processing time, so
    no event is ever too late); one that arrives after that is new. A null key is a key; an empty trigger gives no rows.
    """
    key_type = events.schema[key].dataType
    schema = T.StructType([
        events.schema[key], T.StructField("status", T.StringType()),
        T.StructField("attempt", T.IntegerType()), T.StructField("take", T.BooleanType()),
    ])
    # Whole numbers travel as text: beside a null pandas would make doubles of them.
    text = isinstance(key_type, T.IntegralType)
    kept = pa.schema([
        ("key", to_arrow_type(T.StringType() if text else key_type)), ("failures", pa.int64()), ("completed", pa.bool_()),
        ("opened", pa.int64()), ("seen", pa.int64()),
    ])

    def counted(rows: pa.Table) -> pa.Table:
        sums = [("failures", "sum"), ("completed", "max"), ("opened", "max"), ("seen", "max")]
        return rows.group_by("key", use_threads=False).aggregate(sums).rename_columns(kept.names).cast(kept)

    def fold(group, pieces: Iterator[pd.DataFrame], memory: GroupState) -> Iterator[pd.DataFrame]:
        if memory.hasTimedOut:  # its latest key is too old
            memory.remove()
            return
        now = memory.getCurrentProcessingTimeMs()
        known = kept.empty_table()
        if memory.exists:
            known = pa.ipc.open_stream(bytes(memory.get[0])).read_all()
            known = known.filter(pc.greater(known["seen"], now - keep_ms))
        new = kept.empty_table()
        for piece in pieces:
            rows = pa.table([
                pa.array(piece["key"], kept.field("key").type, from_pandas=True), piece["failures"].to_numpy(),
                pa.array(piece["completed"].to_numpy()), np.zeros(len(piece), np.int64), np.full(len(piece), now),
            ], schema=kept)
            new = counted(pa.concat_tables([new, counted(rows)]))
        # the touched keys stand first, in the same order once they are summed with what is known
        both = counted(pa.concat_tables([new, known]))
        failures, completed, opened = (both[c].to_numpy() for c in ("failures", "completed", "opened"))
        is_open = ~completed & (failures <= retries)
        attempt = np.minimum(failures, retries) + 1
        both = both.set_column(3, "opened", pa.array(np.where(is_open, np.maximum(opened, attempt), opened)))
        # an untouched key opens nothing: its last attempt is opened already
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, kept) as writer:
            writer.write_table(both)
        memory.update((sink.getvalue().to_pybytes(),))
        memory.setTimeoutDuration(keep_ms)
        touched = len(new)
        yield pd.DataFrame({
            "key": both["key"][:touched].to_pandas(),
            "status": np.where(completed, "completed", np.where(is_open, "open", "given_up"))[:touched],
            "attempt": attempt[:touched].astype(np.int32), "take": (is_open & (attempt > opened))[:touched],
        })

    found = T.StructType([T.StructField("key", T.StringType() if text else key_type), *schema.fields[1:]])
    slim = events.select(
        F.col(key).alias("key"), F.coalesce(F.col(state) == "failed", F.lit(False)).cast("long").alias("failures"),
        F.coalesce(F.col(state) == "completed", F.lit(False)).alias("completed"),
    )
    slim = slim.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(KEY_GROUPS)).cast("int"))
    if text:
        slim = slim.withColumn("key", F.col("key").cast("string"))
    changes = slim.groupBy("group").applyInPandasWithState(
        fold, found, "packed binary", "update", GroupStateTimeout.ProcessingTimeTimeout
    )
    return changes.select(F.col("key").cast(key_type).alias(key), "status", "attempt", "take")


def run_worklist(
    changes: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Run ``step(batch, number)`` over :func:`worklist_status`.

    Keys expire with batches that have data. Batches for expiry alone are off: with a
    processing-time timeout one would follow the other and a run over all available input never end.
    """
    conf, name = changes.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:  # the query keeps the setting of its start
        return per_batch(changes, step, checkpoint, interval, mode="update")
    finally:
        conf.set(name, before)


def latest_status(changes: DataFrame, key: str) -> DataFrame:
    """Current status per key from the stored changes with their batch number."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("status", "attempt"), "batch").alias("s"))
    return last.select(key, "s.status", "s.attempt")
