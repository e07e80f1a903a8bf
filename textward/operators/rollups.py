"""Daily rollups of a log that merge: counts, sums and sketches, stored by day.

A day's rows stand for all its entries, so what is asked of any span of days is made from them and
never from the log. A day to which entries have come late is made again, alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Items of a quantile sketch: the rank of a quantile it gives is off by about 0.3 % of the entries.
QUANTILE_ITEMS = 1000
# Buckets of a distinct sketch, as a power of two: its estimate is off by about 0.8 %.
DISTINCT_POWER = 14


def partials(log: DataFrame, by: str, value: str, distinct: str, ts: str = "ts") -> DataFrame:
    """One row per day and ``by``: entries, entries with a value, the values' sum and a sketch of their
    quantiles, and a sketch of the distinct values of ``distinct``.

    Sketches are made on the map side and merged after the shuffle, so a hot key moves one per task. Entries
    without a time belong to no day and are left out.
    """
    return log.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day"), by).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), F.sum(value).alias("total"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), QUANTILE_ITEMS).alias("quantiles"),
        F.hll_sketch_agg(distinct, DISTINCT_POWER).alias("members"),
    )


def store(rows: DataFrame, path: str) -> None:
    """Writes the rollups of whole days; days that are there already are replaced, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def refresh(log: DataFrame, late: DataFrame, path: str, by: str, value: str, distinct: str, ts: str = "ts") -> list[str]:
    """Makes the days of late entries again from the log, which has them by now; returns those days.

    The log is read for those days only. The days come to the driver, as many as the late entries fall on.
    """
    found = late.where(F.col(ts).isNotNull()).select(F.to_date(ts).cast("string").alias("day")).distinct().collect()
    days = sorted(r["day"] for r in found)
    if days:
        store(partials(log.where(F.to_date(ts).cast("string").isin(days)), by, value, distinct, ts), path)
    return days


def read(spark: SparkSession, path: str, since_day: str | None = None, until_day: str | None = None) -> DataFrame:
    """The stored rollups, or those of a span of days, both ends included; other days' folders are not read."""
    rows = spark.read.parquet(path)
    if since_day:
        rows = rows.where(F.col("day") >= F.lit(since_day).cast("date"))
    return rows.where(F.col("day") <= F.lit(until_day).cast("date")) if until_day else rows


def merged(rows: DataFrame, by: str, quantile: float = 0.95) -> DataFrame:
    """One row per ``by`` over all days of the rows: entries, days, mean (exact), the quantile and the number of
    distinct members (both estimates). Mean and quantile are null where there are no values."""
    sketch = F.kll_merge_agg_double(F.when(F.col("n_values") > 0, F.col("quantiles")), QUANTILE_ITEMS)
    return rows.groupBy(by).agg(
        F.sum("n").alias("n"), F.count_distinct("day").alias("days"), F.sum("n_values").alias("n_values"),
        F.sum("total").alias("total"), sketch.alias("sketch"), F.hll_union_agg("members").alias("members"),
    ).select(
        by, "n", "days", "n_values", (F.col("total") / F.col("n_values")).alias("mean"),
        F.when(F.col("n_values") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(quantile))).alias("quantile"),
        F.hll_sketch_estimate("members").alias("members"),
    )
