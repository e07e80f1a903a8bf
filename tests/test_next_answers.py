"""Which assistant turn answers which user turn, whatever numbers lie between."""

import random

import pytest

from textward.plans import screening as P


def plain_answers(rows):
    """For each user turn the text of the next turn at which a user or the assistant speaks, if it is the assistant's."""
    out = {}
    for conv in {r[0] for r in rows}:
        spoken = {}
        for c, turn, role, text in rows:
            if c == conv and role in ("user", "assistant"):
                spoken.setdefault(turn, {})[role] = text
        order = sorted(spoken)
        for at, turn in enumerate(order):
            if "user" in spoken[turn]:
                after = spoken[order[at + 1]] if at + 1 < len(order) else {}
                out[conv, turn] = after.get("assistant")
    return out


@pytest.mark.parametrize("per_chunk", [1, 3, 1024])
def test_gaps_and_chunks(spark, monkeypatch, per_chunk):
    monkeypatch.setattr(P, "TURNS_PER_CHUNK", per_chunk)
    rng = random.Random(per_chunk)
    rows = []
    for conv in range(12):
        turn = rng.randrange(-5, 5)
        for i in range(rng.randrange(0, 25)):
            turn += rng.choice([1, 1, 2, 7])
            rows.append((conv, turn, rng.choice(["user", "user", "assistant", "assistant", "system", "tool"]), f"{conv}:{turn}"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r.conv_id, r.turn): r.response for r in P.user_turns(df).collect()}
    assert got == plain_answers(rows) and any(got.values()) and not all(got.values())


def test_the_answer_may_come_two_turns_later(spark):
    rows = [(1, 0, "user", "p"), (1, 2, "assistant", "a"), (1, 3, "user", "q"), (1, 9, "assistant", "b"), (1, 10, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.turn: r.response for r in P.user_turns(df).collect()} == {0: "a", 3: "b"}
    assert [(r.turn, r.prompt, r.response) for r in P.last_turns(df).collect()] == [(3, "q", "b")]


def test_rows_without_a_conversation_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 0, "user", "p"), (None, 1, "assistant", "a"), (2, None, "user", "q"), (3, 0, "assistant", "alone")]
    got = [(r.conv_id, r.turn, r.prompt, r.response) for r in P.user_turns(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == [(2, None, "q", None), (None, 0, "p", None)]
    assert P.user_turns(spark.createDataFrame([], schema)).count() == 0


def test_one_conversation_of_many_turns_is_spread(spark):
    """Half of all turns in one conversation: no task sees more of it than a few chunks."""
    from pyspark.sql import functions as F

    n = 200_000
    turns = spark.range(n).select(
        F.lit(1).cast("long").alias("conv_id"), (F.col("id") * 2).alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = P.user_turns(turns)
        assert out.where("cast(response as long) = cast(prompt as long) + 1").count() == n // 2
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < n // 4
