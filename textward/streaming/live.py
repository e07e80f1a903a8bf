"""Screening, counting and deduplicating rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textward.functions.text import near_duplicate_key
from textward.operators import ensemble as E
from textward.plans import screening
from textward.sources import decision_log


def read_stream(
    spark: SparkSession, folder: str, schema, files: str | None = None, max_files: int | None = None
) -> DataFrame:
    """The Parquet files of a folder as a stream; files that arrive later are picked up.

    ``files`` is a pattern for the names of those that belong to it. One that names a folder stands for the
    files in it, as a table is one file or a folder of them.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # In braces, a name is a pattern too: Spark streams from folders, or from whatever a pattern finds.
    return reader.parquet(f"{folder}/{{{files}}}" if files else folder)


def pair_turns(
    prompts: DataFrame, answers: DataFrame, ts: str = "ts", wait: str = "10 minutes"
) -> DataFrame:
    """User turns with the assistant turn after them, as a stream-stream join.

    A prompt whose answer does not come within ``wait`` goes out without one. State is bounded
    by the watermark and keyed by (conversation, turn).
    """
    p = prompts.select(
        "conv_id", "turn", F.col("text").alias("prompt"), F.col(ts).alias("ts")
    ).withWatermark("ts", wait).alias("p")
    a = answers.select(
        F.col("conv_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"),
        F.col(ts).alias("answer_ts"),
    ).withWatermark("answer_ts", wait).alias("a")
    together = (
        (F.col("p.conv_id") == F.col("a.conv_id"))
        & (F.col("p.turn") == F.col("a.turn"))
        & (F.col("a.answer_ts") >= F.col("p.ts"))
        & (F.col("a.answer_ts") <= F.col("p.ts") + F.expr(f"interval {wait}"))
    )
    return p.join(a, together, "leftOuter").select("p.conv_id", "p.turn", "p.ts", "prompt", "response")


def screen_stream(
    requests: DataFrame,
    registry: E.Registry = E.DEFAULT_REGISTRY,
    options: screening.Options = screening.Options(),
) -> DataFrame:
    """The batch plan, which needs no state when a record holds prompt and response."""
    return screening.screen(requests, registry, options)


def append_to_log(results: DataFrame, log: str, checkpoint: str, trigger: dict, source: str = "stream") -> StreamingQuery:
    """Appends every micro-batch to the decision log, where batch jobs append too.

    The batch's number is its name there: repeated after a restart, it replaces what it wrote, so no
    entry is lost or doubled. Several streams into one log take different ``source`` names.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decision_log.append(screening.log_entries(batch), log, f"{source}-{batch_id}")

    return (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def decision_windows(
    log: DataFrame, width: str = "1 minute", late: str = "10 minutes", ts: str = "ts",
    by: str = "decision", latency: str = "total_latency_ms",
) -> DataFrame:
    """Counts and mean latency per time window and decision; state ends with the watermark.

    On a batch DataFrame the watermark means nothing and the result is complete.
    """
    return (
        log.withWatermark(ts, late)
        .groupBy(F.window(ts, width), by)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(latency).alias("mean_latency_ms"))
        .select(
            F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
            by, "n", "mean_latency_ms",
        )
    )


def first_arrivals(
    rows: DataFrame, ts: str = "ts", within: str = "1 hour", text: str = "text", salts: int = 16,
    prefix_chars: int | None = None,
) -> DataFrame:
    """Rows whose near-duplicate key has not arrived within the watermark.

    The first to arrive wins, not the first in order. Copies are first dropped per (key, salt),
    the salt coming from the whole row, so that a key many rows share is spread over ``salts``
    tasks and at most that many rows of it go on to the task that keeps one.
    """
    salt = F.pmod(F.xxhash64(F.struct(*[F.col(c) for c in rows.columns])), F.lit(salts))
    keyed = (
        rows.withColumn("__salt", salt)
        .withColumn("near_key", near_duplicate_key(F.col(text), prefix_chars))
        .withWatermark(ts, within)
    )
    if salts > 1:
        keyed = keyed.dropDuplicatesWithinWatermark(["near_key", "__salt"])
    return keyed.dropDuplicatesWithinWatermark(["near_key"]).drop("__salt")


def write_table(results: DataFrame, path: str, checkpoint: str, trigger: dict, mode: str = "append") -> StreamingQuery:
    return (
        results.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )
