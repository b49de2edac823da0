"""Chat formatting: cheapest repair of the role sequence, then rendering.

A legal sequence has an optional system turn first, then user and assistant in
turns, user first, and may end after either. Each turn of a conversation is either kept, relabelled,
or merged into the turn before, and an empty turn may be inserted before it; every action has a cost. The
automaton's states are the roles of the last turn, so a turn is a 4 x 4 min-plus
matrix. Turns are cut into blocks of ``BLOCK``; a block is one matrix, blocks are folded per
conversation, and each block is traced back with its entry and exit state given. A conversation of any length is
spread over tasks; what comes together per conversation is one matrix per block.

The result has one row per output turn piece: ``piece`` says which input row it stems from (null turn: an
insertion), ``out_turn`` the repaired turn, ``role`` its role, ``action`` what was done and ``rendered`` the text
such that the pieces of a conversation in order of (out_turn, seq) are the rendered conversation.

Defined results: roles are compared trimmed and lower case; null or other roles are unknown and cost the
least to relabel; null texts are empty; equal (conversation, turn) rows follow by role and text; a null conversation id is
one conversation; null turns come first; turns of one conversation need not be consecutive. Ties between repairs go to the
earlier action in the order keep, relabel, merge, and to the state order of ``ROLES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdictframe.llm.shared import stored

ROLES = ("system", "user", "assistant")
#: States: nothing yet, then the role of the last turn.
STATES = 4
#: Role that may follow a state directly.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
COSTS = {"relabel_unknown": 1.0, "merge_same": 1.0, "insert": 2.0, "relabel": 3.0, "merge_other": 5.0}
UNKNOWN = 3
#: Turns of a block.
BLOCK = 256


def step(role: int) -> tuple[np.ndarray, list]:
    """Cost of one turn from state to state, and what it does: (action, inserted state or 0)."""
    cost = np.full((STATES, STATES), np.inf)
    what: list = [[None] * STATES for _ in range(STATES)]

    def offer(a: int, b: int, value: float, action: str, inserted: int) -> None:
        if value < cost[a, b]:
            cost[a, b] = value
            what[a][b] = (action, inserted)

    def place(a: int, b: int, extra: float, inserted: int) -> None:
        if b in NEXT[a]:
            if role == b - 1:
                offer(inserted_from[a, inserted], b, extra, "keep", inserted)
            elif role == UNKNOWN:
                offer(inserted_from[a, inserted], b, extra + COSTS["relabel_unknown"], "relabel", inserted)
            else:
                offer(inserted_from[a, inserted], b, extra + COSTS["relabel"], "relabel", inserted)

    inserted_from: dict = {}
    for a in range(STATES):
        inserted_from[a, 0] = a
        for b in range(1, STATES):
            place(a, b, 0.0, 0)
        for empty in NEXT[a]:
            inserted_from[empty, empty] = a
            for b in range(1, STATES):
                place(empty, b, COSTS["insert"], empty)
        if a:
            same = role == a - 1 or role == UNKNOWN
            offer(a, a, COSTS["merge_same" if same else "merge_other"], "merge", 0)
    return cost, what


STEPS = [step(r) for r in range(UNKNOWN + 1)]


def join_costs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (first[:, :, None] + second[None]).min(axis=1)


def block_costs(roles: np.ndarray) -> np.ndarray:
    total = np.where(np.eye(STATES, dtype=bool), 0.0, np.inf)
    for r in roles:
        total = join_costs(total, STEPS[r][0])
    return total


def trace(roles: np.ndarray, start: int, stop: int) -> list[tuple[int, str, int]]:
    """(state, action, inserted) of every turn on the cheapest way between two states; the first of equals."""
    ahead = np.full((len(roles) + 1, STATES), np.inf)
    ahead[-1, stop] = 0.0
    for k in range(len(roles) - 1, -1, -1):
        ahead[k] = (STEPS[roles[k]][0] + ahead[k + 1]).min(axis=1)
    out, state = [], start
    order = {"keep": 0, "relabel": 1, "merge": 2}
    for k, r in enumerate(roles):
        cost, what = STEPS[r]
        total = cost[state] + ahead[k + 1]
        ways = [s for s in range(STATES) if total[s] <= ahead[k, state] + 1e-9 and np.isfinite(total[s])]
        new = min(ways, key=lambda s: (order[what[state][s][0]], what[state][s][1], s))
        out.append((new, *what[state][new]))
        state = new
    return out


def numbered_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with their place in the conversation, in blocks of ``BLOCK``; ranges of the whole order are numbered first."""
    known = F.lower(F.trim(F.col(role)))
    code = F.lit(UNKNOWN)
    for k, name in enumerate(ROLES):
        code = F.when(known == name, k).otherwise(code)
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), code.cast("int").alias("code"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    keys = ["conv", "turn", "code", "text"]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "turns")
    # the place in a conversation: inside its range partition, shifted by what earlier partitions hold of it
    ranged = ranged.withColumn("bin", F.shiftright("at", 33))
    inside = ranged.groupBy("conv", "bin").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # stored, so that the join deals out both sides anew and may split a long conversation
    shifts = stored(inside.select(F.col("conv").alias("c"), F.col("bin").alias("b"), "first", before.alias("before")), "shifts")
    out = ranged.join(shifts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("bin") == F.col("b")))
    seq = F.col("at") - F.col("first") + F.col("before")
    return out.select("conv", "turn", "code", "text", seq.alias("seq"), F.floor(seq / BLOCK).alias("block"))


def repair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, out_turn, seq, turn, role, action, rendered) for every piece of every repaired conversation."""
    rows = stored(numbered_turns(turns, conv, turn, role, text), "turns")
    kind = dict(rows.dtypes)["conv"]
    turn_kind = dict(rows.dtypes)["turn"]

    codes = rows.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "code"))).alias("rows"))
    codes = codes.select("conv", "block", F.col("rows.code").alias("codes"))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_costs(np.asarray(c.values, dtype=np.int64)).ravel() for c in batch.column(2)]
            flat = pa.array([v.tolist() for v in found], type=pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["conv", "block", "cost"])

    matrices = codes.mapInArrow(costs, f"conv {kind}, block long, cost array<double>")
    whole = matrices.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "cost"))).alias("all"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entry and exit state of every block of a conversation."""
        for batch in batches:
            conv_at, block, start, stop, cost = [], [], [], [], []
            for k, one in enumerate(batch.column(1)):
                m = [np.array(x["cost"]).reshape(STATES, STATES) for x in one.as_py()]
                ahead = [np.zeros(STATES)]
                for x in reversed(m):
                    ahead.append((x + ahead[-1]).min(axis=1))
                ahead.reverse()
                state = 0
                for b, x in enumerate(m):
                    new = int((x[state] + ahead[b + 1]).argmin())
                    conv_at.append(k)
                    block.append(b)
                    start.append(state)
                    stop.append(new)
                    cost.append(float(ahead[0][0]))
                    state = new
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(conv_at, type=pa.int64())), pa.array(block, type=pa.int64()), pa.array(start, type=pa.int32()),
                 pa.array(stop, type=pa.int32()), pa.array(cost, type=pa.float64())],
                names=["conv", "block", "start", "stop", "cost"],
            )

    ways = whole.mapInArrow(fold, f"conv {kind}, block long, start int, stop int, cost double")
    ways = stored(ways, "ways").select(F.col("conv").alias("c"), F.col("block").alias("b"), "start", "stop", "cost")
    joined = rows.join(ways, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    traced_in = joined.groupBy("conv", "block", "start", "stop", "cost").agg(
        F.sort_array(F.collect_list(F.struct("seq", "turn", "code", "text"))).alias("rows")
    )

    names = ["seq", "turn", "role", "action", "opens", "text", "cost"]

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], [[] for _ in names]
            for k in range(batch.num_rows):
                rows_in = batch.column(5)[k].as_py()
                roles = np.array([r["code"] for r in rows_in])
                cost = batch.column(4)[k].as_py()
                for r, (state, action, inserted) in zip(rows_in, trace(roles, batch.column(2)[k].as_py(), batch.column(3)[k].as_py())):
                    if inserted:
                        at.append(k)
                        for values, v in zip(out, (2 * r["seq"], None, ROLES[inserted - 1], "insert", 1, "", cost)):
                            values.append(v)
                    at.append(k)
                    for values, v in zip(out, (2 * r["seq"] + 1, r["turn"], ROLES[state - 1], action, int(action != "merge"), r["text"], cost)):
                        values.append(v)
            kinds = [pa.int64(), batch.column(5).type.value_type.field("turn").type, pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, type=pa.int64())), batch.column(1).take(pa.array(at, type=pa.int64())),
                 *[pa.array(v, type=t) for v, t in zip(out, kinds)]],
                names=["conv", "block", *names],
            )

    pieces = traced_in.mapInArrow(
        traced, f"conv {kind}, block long, seq long, turn {turn_kind}, role string, action string, opens long, text string, cost double"
    )
    pieces = stored(pieces, "pieces")
    # number the output turns: inside a block, shifted by the turns that earlier blocks open
    opened = pieces.groupBy("conv", "block").agg(F.sum("opens").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    opened = stored(opened.select(F.col("conv").alias("c"), F.col("block").alias("b"), earlier.alias("earlier")), "opened")
    order = Window.partitionBy("conv", "block").orderBy("seq")
    pieces = pieces.withColumn("inside", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = pieces.join(opened, F.col("conv").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    out_turn = F.col("earlier") + F.col("inside") - 1
    # a piece that opens a turn closes the one before it
    head = F.concat(F.when(out_turn > 0, "<|end|>\n").otherwise(""), F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"))
    return pieces.select(
        F.col("conv").alias(conv), out_turn.alias("out_turn"), "seq", F.col("turn").alias(turn), "role", "action", F.col("cost").alias("repair_cost"),
        F.when(F.col("opens") == 1, head).otherwise(F.concat(F.lit("\n"), F.col("text"))).alias("rendered"),
    )
