"""Streams that end, compared with the batch jobs."""

import datetime as dt

from pyspark.sql import functions as F

from textward.plans import screening
from textward.sources import decision_log
from textward.streaming import live

ONCE = {"availableNow": True}
BASE = dt.datetime(2024, 1, 1)


def write_files(spark, rows, schema, path, files=3):
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(path)


def test_screening_over_several_batches(spark, tmp_path):
    schema = "id long, prompt string, response string"
    replies = ["ok", "you idiot", "mail a@b.co", None]
    rows = [(i, "hello there" if i % 5 else "jailbreak now", replies[i % 4]) for i in range(40)]
    path, log = str(tmp_path / "in"), str(tmp_path / "log")
    write_files(spark, rows, schema, path)
    for _ in range(2):  # the second start finds nothing new
        stream = live.read_stream(spark, path, schema, max_files=1)
        q = live.append_to_log(live.screen_stream(stream), log, str(tmp_path / "cp"), ONCE)
        q.awaitTermination()
    stored = decision_log.read(spark, log)
    assert stored.select("batch").distinct().count() == 3
    batch = screening.log_entries(screening.screen(spark.read.schema(schema).parquet(path)))
    columns = ["id", "type", "decision", "response", "detail"]
    key = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert key(stored) == key(batch)


def test_pairs_and_prompts_left_alone(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    rows = []
    for c in range(4):
        start = BASE + dt.timedelta(minutes=c)
        rows.append((c, 0, "user", f"p{c}", start))
        if c != 2:
            rows.append((c, 1, "assistant", f"a{c}", start + dt.timedelta(seconds=5)))
    # Much later turns move the watermark past the prompt nobody answered.
    later = BASE + dt.timedelta(hours=5)
    rows += [(9, 0, "user", "late", later), (9, 1, "assistant", "reply", later)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(spark, rows, schema, path, files=1)
    write_files(spark, [(10, 0, "user", "end", later + dt.timedelta(hours=5)), (10, 1, "assistant", "x", later + dt.timedelta(hours=5))], schema, path, files=1)
    stream = live.read_stream(spark, path, schema, max_files=1)
    other = live.read_stream(spark, path, schema, max_files=1)
    pairs = live.pair_turns(stream.filter("role = 'user'"), other.filter("role = 'assistant'"))
    live.write_table(pairs, out, str(tmp_path / "cp"), ONCE).awaitTermination()
    got = {(r["conv_id"], r["response"]) for r in spark.read.parquet(out).collect()}
    assert {(0, "a0"), (1, "a1"), (2, None), (3, "a3"), (9, "reply")} <= got


def test_windows(spark, tmp_path):
    schema = "ts timestamp, decision string, total_latency_ms double"
    rows = [(BASE + dt.timedelta(seconds=20 * i), "ALLOWED" if i % 3 else "BLOCKED", float(i)) for i in range(30)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(spark, rows, schema, path)
    counts = live.decision_windows(live.read_stream(spark, path, schema), "1 minute", "1 minute")
    live.write_table(counts, out, str(tmp_path / "cp"), ONCE).awaitTermination()
    # Append mode gives a window once the watermark has passed its end.
    stored = {tuple(r) for r in spark.read.parquet(out).collect()}
    whole = {tuple(r) for r in live.decision_windows(spark.read.schema(schema).parquet(path), "1 minute").collect()}
    assert stored and stored <= whole
    assert sum(r[3] for r in whole) == 30


def test_first_arrivals(spark, tmp_path):
    schema = "id long, ts timestamp, text string"
    rows = [(i, BASE + dt.timedelta(seconds=i), f"Text {i % 7}" if i % 2 else f" text {i % 7} ") for i in range(50)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(spark, rows, schema, path)
    first = live.first_arrivals(live.read_stream(spark, path, schema, max_files=1))
    live.write_table(first, out, str(tmp_path / "cp"), ONCE).awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select("near_key").distinct().count() == 7
    assert stored.filter(F.col("text").isNull()).isEmpty()
