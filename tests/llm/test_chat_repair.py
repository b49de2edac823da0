import random

import pytest

from verdictframe.llm import chat_repair

NAMES = ["system", "user", "assistant", None]


def cheapest(roles):
    """All repairs of a short conversation, tried one after the other."""
    best = {0: 0.0}
    for r in roles:
        nxt = {}
        for state, cost in best.items():
            ways = []
            for empty in [None, *chat_repair.NEXT[state]]:
                at, extra = (state, 0.0) if empty is None else (empty, chat_repair.COSTS["insert"])
                for b in chat_repair.NEXT[at]:
                    change = 0.0 if r == b - 1 else chat_repair.COSTS["relabel_unknown" if r == 3 else "relabel"]
                    ways.append((b, extra + change))
            if state:
                ways.append((state, chat_repair.COSTS["merge_same" if r in (state - 1, 3) else "merge_other"]))
            for b, x in ways:
                nxt[b] = min(nxt.get(b, 1e9), cost + x)
        best = nxt
    return min(best.values())


def paid(pieces, roles):
    total = 0.0
    before = None
    for p in pieces:
        if p["action"] == "insert":
            total += chat_repair.COSTS["insert"]
        elif p["action"] == "relabel":
            total += chat_repair.COSTS["relabel_unknown" if roles[p["turn"]] == 3 else "relabel"]
        elif p["action"] == "merge":
            same = NAMES[roles[p["turn"]]] in (before, None)
            total += chat_repair.COSTS["merge_same" if same else "merge_other"]
        before = p["role"]
    return total


@pytest.mark.parametrize("block", [256, 4])
def test_legal_cheapest_and_whole(spark, monkeypatch, block):
    monkeypatch.setattr(chat_repair, "BLOCK", block)
    rng = random.Random(2)
    chats = {k: [rng.randrange(4) for _ in range(rng.randint(1, 40))] for k in range(40)}
    rows = [(k, j, NAMES[r], f"t{j}") for k, roles in chats.items() for j, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = {}
    for r in chat_repair.repair(df).collect():
        out.setdefault(r["conv_id"], []).append(r)
    legal = {("system", "user"), ("user", "assistant"), ("assistant", "user")}
    for k, roles in chats.items():
        pieces = sorted(out[k], key=lambda r: r["seq"])
        opened = [p["role"] for p in pieces if p["action"] != "merge"]
        assert opened[0] in ("system", "user") and set(zip(opened, opened[1:])) <= legal
        assert [p["turn"] for p in pieces if p["turn"] is not None] == list(range(len(roles)))
        assert abs(pieces[0]["repair_cost"] - cheapest(roles)) < 1e-9 and abs(paid(pieces, roles) - cheapest(roles)) < 1e-9
        assert [p["out_turn"] for p in pieces] == sorted(p["out_turn"] for p in pieces) and pieces[-1]["out_turn"] == len(opened) - 1


def test_rendering(spark):
    rows = [(1, 0, " User ", "hi"), (1, 1, "user", "again"), (1, 2, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    text = "".join(r["rendered"] for r in chat_repair.repair(df).orderBy("out_turn", "seq").collect())
    assert text == "<|user|>\nhi\nagain<|end|>\n<|assistant|>\n"


def test_defined_results(spark):
    from pyspark.sql import functions as F

    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", "a"), (None, None, "assistant", "b"), (2, 5, "tool", ""), (2, 5, "tool", ""), (3, 0, None, "x" * 500_000)]
    df = spark.createDataFrame(rows, schema).withColumns({"c": F.lit("own"), "block": F.lit("own"), "seq": F.lit("own")})
    out = chat_repair.repair(df).collect()
    assert sum(r["action"] != "insert" for r in out) == 5
    assert len({r["conv_id"] for r in out}) == 3
    assert chat_repair.repair(df.limit(0)).count() == 0


def test_one_conversation_holds_all_rows(spark):
    df = spark.range(20_000).selectExpr("1L conv_id", "id turn", "CASE id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'user' END role", "'x' text")
    out = chat_repair.repair(df)
    assert out.filter("turn is not null").count() == 20_000
