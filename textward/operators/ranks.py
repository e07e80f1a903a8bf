"""Running totals and rank picks over ordered values, without sorting a slice in one task.

The input has one row per (slice, value), already counted. Values are cut into ranges at
approximate quantiles, enough that a range holds about ``ROWS_PER_RANGE`` rows; totals per
(slice, range) are summed up in a window of one row per range, and each range is then summed up
by itself. A table that small has one range and needs no quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.session import staged

ROWS_PER_RANGE = 250_000
MAX_RANGES = 2048


def range_bounds(df: DataFrame, value: str) -> list[float]:
    """Increasing values that cut the column into similar parts, fewer than ``MAX_RANGES``.

    They come to the driver and are used as literals, so that a task that is run again puts a
    value into the same range. They only share out the work; any bounds give the same result.
    """
    ranges = min(MAX_RANGES, -(-df.count() // ROWS_PER_RANGE))
    if ranges <= 1:
        return []
    points = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(value, points, 10 * ranges)).first()[0]
    return sorted({float(v) for v in found or []})


def _with_range(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Adds the number of the range a value is in, growing with the value."""
    if not bounds:
        return df.withColumn("__range", F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    numbered = Bucketizer(splits=splits, inputCol="__value", outputCol="__range", handleInvalid="keep")
    out = numbered.transform(df.withColumn("__value", F.col(value).cast("double"))).drop("__value")
    return out.withColumn("__range", F.col("__range").cast("int"))


def running_totals(
    df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str]
) -> DataFrame:
    """Adds, per summed column, ``<c>_below`` (rows of smaller value) and ``<c>_total``.

    ``df`` has one row per (slice, value), no null values, and should be staged: it is read
    up to four times.
    """
    bounds = range_bounds(df, value)
    # One key that is never null, so that the windows and the join below agree on where rows go.
    # Each part is preceded by its length, so different slices have different keys.
    part = lambda c: F.concat(F.length(c.cast("string")), F.lit(":"), c.cast("string"))
    slice_key = F.concat(*[F.coalesce(part(F.col(c)), F.lit("-")) for c in by])
    ranged = _with_range(df, value, bounds).withColumn("__slice", slice_key)
    key = ["__slice", "__range"]
    per_range = ranged.groupBy(*key).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    within = Window.partitionBy("__slice")
    earlier = within.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *key,
        *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__{c}_before") for c in sums],
        *[F.sum(f"__{c}").over(within).alias(f"{c}_total") for c in sums],
    )
    local = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumns({f"__{c}_local": F.coalesce(F.sum(c).over(local), F.lit(0)) for c in sums})
        .join(offsets, key)
        .select(
            *df.columns,
            *[(F.col(f"__{c}_before") + F.col(f"__{c}_local")).alias(f"{c}_below") for c in sums],
            *[f"{c}_total" for c in sums],
        )
    )


def value_at_rank(
    df: DataFrame, by: Sequence[str], value: str, rank, into: str = "picked"
) -> DataFrame:
    """Per slice, the value at a zero-based rank of the ascending order.

    ``rank`` maps a slice's row count to the rank. Copies of a value are counted, not sorted.
    """
    counted = staged(
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n")),
        "value-counts",
    )
    placed = running_totals(counted, by, value, ["n"])
    at = rank(F.col("n_total"))
    return placed.filter((F.col("n_below") <= at) & (at < F.col("n_below") + F.col("n"))).select(
        *by, F.col(value).alias(into)
    )


def p95_rank(n: Column) -> Column:
    """Zero-based rank of the 95th percentile, half to even."""
    return F.bround(F.lit(0.95) * (n - 1).cast("double")).cast("bigint")
