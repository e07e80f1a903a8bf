"""One log for batch jobs and streams: repeats replace, days are read alone."""

import datetime as dt
import os

from pyspark.sql import functions as F

from textward.sources import decision_log
from textward.streaming import live

SCHEMA = "id string, ts timestamp, decision string"


def entries(spark, ids, start=dt.datetime(2024, 3, 1), step=dt.timedelta(hours=6)):
    return spark.createDataFrame([(f"{i:06d}", start + i * step, "ALLOWED" if i % 3 else "BLOCKED") for i in ids], SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_a_repeated_batch_replaces_itself_alone(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch, rows in (("a", range(0, 10)), ("b", range(10, 20)), (3, range(20, 30))):
        decision_log.append(entries(spark, rows), path, batch)
    before = ids(decision_log.read(spark, path))
    decision_log.append(entries(spark, range(10, 20)), path, "b")
    assert ids(decision_log.read(spark, path)) == before == [f"{i:06d}" for i in range(30)]
    # The second time, the batch has other rows, which fall on other days.
    decision_log.append(entries(spark, range(40, 43)), path, "b")
    log = decision_log.read(spark, path)
    assert ids(log) == [f"{i:06d}" for i in [*range(10), *range(20, 30), *range(40, 43)]]
    decision_log.append(entries(spark, range(50, 52)), path)
    decision_log.append(entries(spark, range(50, 52)), path)
    assert decision_log.read(spark, path).count() == log.count() + 4


def test_a_batch_repeated_after_midnight(spark, tmp_path):
    """Entries without a time get that of writing; a repeat on another day leaves none on the first."""
    path = str(tmp_path / "log")
    yesterday = entries(spark, [1]).withColumn("ts", F.current_timestamp() - F.expr("interval 1 day"))
    decision_log.append(yesterday, path, 7)
    decision_log.append(entries(spark, [1, 2]).drop("ts"), path, 7)
    log = decision_log.read(spark, path)
    assert ids(log) == ["000001", "000002"] and log.select("day").distinct().count() == 1


def test_newest_reads_the_last_days_only(spark, tmp_path):
    path = str(tmp_path / "log")
    decision_log.append(entries(spark, range(400)), path, "all")  # four entries a day, 100 days
    days = decision_log.days_of(decision_log.read(spark, path))
    assert len(days) == 100 and days[0] == "2024-03-01"
    for limit in (1, 4, 5, 30, 400, 1000):
        got = decision_log.newest_of(spark, path, limit)
        assert [r["id"] for r in got.collect()] == [f"{i:06d}" for i in range(399, max(-1, 399 - limit), -1)]
    plan = decision_log.newest_of(spark, path, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and days[-2] in plan.replace(str((dt.date.fromisoformat(days[-2]) - dt.date(1970, 1, 1)).days), days[-2])
    since = decision_log.read(spark, path, "2024-06-07")
    assert ids(since) == [f"{i:06d}" for i in range(392, 400)]


def test_a_compacted_copy_has_the_same_entries(spark, tmp_path):
    path, into = str(tmp_path / "log"), str(tmp_path / "compacted")
    for batch in range(6):
        decision_log.append(entries(spark, range(batch, 60, 6)), path, batch)
    for _ in range(2):
        decision_log.compact(spark, path, into, "2024-03-11")
    copy = decision_log.read(spark, into)
    assert ids(copy) == [f"{i:06d}" for i in range(40)] and {r[0] for r in copy.select("batch").distinct().collect()} == {"compacted"}
    files = lambda p: sum(f.endswith(".parquet") for _, _, names in os.walk(p) for f in names)
    assert files(into) <= files(path)


def test_stream_and_batch_share_a_log(spark, tmp_path):
    schema = "id string, prompt string, response string"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([(f"s{i}", "hello there", "ok") for i in range(6)], schema).repartition(2).write.parquet(source)
    from textward.plans import screening

    decision_log.append(screening.log_entries(screening.screen(spark.createDataFrame([("b0", "hello", "ok")], schema))), log)
    stream = live.screen_stream(live.read_stream(spark, source, schema, max_files=1))
    live.append_to_log(stream, log, str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
    today = decision_log.days_of(decision_log.read(spark, log))[0]
    assert ids(decision_log.read(spark, log, today)) == ["b0", *[f"s{i}" for i in range(6)]]


def test_an_empty_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    decision_log.append(entries(spark, range(3)), path, "a")
    decision_log.append(entries(spark, []), path, "b")
    assert decision_log.read(spark, path).count() == 3
    decision_log.append(entries(spark, []), path, "a")
    assert decision_log.read(spark, path).count() == 0
