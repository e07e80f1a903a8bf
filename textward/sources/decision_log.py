"""The decision log: one table for batch jobs and streams, and the views on it.

Entries lie under ``day=.../batch=...``. A day's folder can be read alone, and a batch that is
written again replaces what it wrote before, so a job or a stream that restarts neither loses nor
doubles entries.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.operators.summaries import decision_counts

DEFAULT_ENTRIES = 50

LOG_COLUMNS = [
    "type", "prompt", "response", "decision", "scores", "latencies_ms", "total_latency_ms", "detail",
    "failed_filters",
]

_DAY = re.compile(r"/day=([^/]+)/")


def stamped(entries: DataFrame) -> DataFrame:
    """Adds the UTC time as ``ts`` and an eight-character ``id``, unless a row brings its own."""
    if "ts" not in entries.columns:
        entries = entries.withColumn("ts", F.current_timestamp())
    if "id" not in entries.columns:
        entries = entries.withColumn("id", F.substring(F.uuid(), 1, 8))
    return entries


def days_of(log: DataFrame) -> list[str]:
    """The days of a log's files, from their paths alone; entries without a time have none."""
    return sorted({m[1] for f in log.inputFiles() if (m := _DAY.search(f)) and not m[1].startswith("__")})


def _folder(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/{pattern}")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append(entries: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Adds the entries to the log, under their days and the name of the batch.

    A batch of a name the log has already replaces it, on all days it had; without a name it is a new one.
    The table keeps everything; what is bounded are the views on it. A day's entries of a batch lie in one file,
    or in a few if there are many, whatever number of tasks made them.
    """
    spark = entries.sparkSession
    before = _folder(spark, path, f"day=*/batch={batch}") if batch is not None else None
    old_days = set(days_of(before)) if before is not None else set()
    name = uuid.uuid4().hex if batch is None else str(batch)
    rows = stamped(entries).withColumn("day", F.to_date("ts")).withColumn("batch", F.lit(name))
    rows.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)
    if old_days:
        # A repeated batch whose entries fall on other days now: the folders it had there become empty.
        written = rows.select(F.col("day").cast("string")).distinct() if "ts" in entries.columns else None
        new_days = {r[0] for r in written.collect()} if written is not None else set()
        after = _folder(spark, path, f"day=*/batch={batch}") if old_days - new_days else None
        if written is None:
            new_days = {days_of(after)[-1]}
        for day in old_days - new_days:
            nothing = after.drop("day", "batch").limit(0)
            nothing.write.mode("overwrite").parquet(f"{path}/day={day}/batch={batch}")


def read(spark: SparkSession, path: str, since_day: str | None = None) -> DataFrame:
    """The log, or only its days from ``since_day`` on, whose folders alone are then read."""
    log = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("string"))
    return log.filter(F.col("day") >= F.lit(since_day).cast("date")) if since_day else log


def newest(log: DataFrame, limit: int = DEFAULT_ENTRIES, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """The newest entries, newest first: a top-k, each task keeping at most ``limit`` rows."""
    if limit < 1:
        raise ValueError("`limit` must be at least 1.")
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def newest_of(spark: SparkSession, path: str, limit: int = DEFAULT_ENTRIES) -> DataFrame:
    """The newest entries of a stored log by time and id, read from its last days only.

    Days are counted from the end, twice as many each time, until they hold ``limit`` entries; a count reads no
    column and stops at the limit. The days before are not read, however long the log is.
    """
    log = read(spark, path)
    days = days_of(log)[::-1]
    if not days:
        return newest(log, limit)
    since = lambda n: log.filter(F.col("day") >= F.lit(days[min(n, len(days)) - 1]).cast("date"))
    n = 1
    while n < len(days) and since(n).select("day").limit(limit).count() < limit:
        n *= 2
    # Entries without a time are in no day's folder; they come last, if there is room.
    return newest(since(n) if n < len(days) else log, limit)


def compact(spark: SparkSession, path: str, into: str, before_day: str) -> None:
    """Copies the days before ``before_day`` to the log ``into``, each as one batch called ``compacted``.

    Nothing is changed at ``path``. Repeated, it replaces the days it has written. Readers go over to the copy
    when it is done, and the days from ``before_day`` on are appended to it as the batches they were.
    """
    old = read(spark, path).filter(F.col("day") < F.lit(before_day).cast("date")).withColumn("batch", F.lit("compacted"))
    rows = old.hint("rebalance", "day").sortWithinPartitions("day", "ts")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(into)


def by_decision(log: DataFrame, decision: str = "ALL") -> DataFrame:
    return log if decision == "ALL" else log.filter(F.col("decision") == decision)


def recent_stats(log: DataFrame, limit: int | None = None, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Decision counts over the log; if asked, over its newest ``limit`` entries."""
    return decision_counts(log if limit is None else newest(log, limit, order))
