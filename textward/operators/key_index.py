"""Deduplication against everything kept before: a stored index of keys, extended by each delivery.

The index lies under ``prefix=.../delivery=...``: by the first digits of the key's hash, so that a
delivery reads only where it has keys itself, and by delivery, so that one that is repeated neither
finds its own keys nor adds them twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions.text import near_duplicate_key
from textward.session import staged

# Hexadecimal digits that choose a folder, if no other number is given: 256 folders. An index keeps its number.
DIGITS = 2


def stored(spark: SparkSession, index: str) -> DataFrame | None:
    """The keys of an index (prefix, delivery, key), or nothing if it has none yet."""
    try:
        kept = spark.read.parquet(index)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return kept.select(F.col("prefix").cast("string"), F.col("delivery").cast("string"), "key")


def first_keys(df: DataFrame, key: Column, order: str, digits: int = DIGITS) -> DataFrame:
    """(key, prefix, order) of the first row of each key, the key as a hash of 256 bits; null keys left out.

    Combined on the map side, so a key that many rows share brings one row per task.
    """
    digest = F.sha2(key.cast("binary"), 256)
    hashed = df.select(digest.alias("digest"), F.col(order).alias(order)).where("digest is not null")
    first = hashed.groupBy("digest").agg(F.min(order).alias(order))
    # A letter in front keeps folders of digits from being read as numbers.
    return first.select(F.unhex("digest").alias("key"), F.concat(F.lit("k"), F.substring("digest", 1, digits)).alias("prefix"), order)


def against(firsts: DataFrame, index: str, delivery: str | int) -> DataFrame:
    """The rows of ``first_keys`` whose key no other delivery has brought.

    Only folders of prefixes that the rows have are read; there are 16 ** digits of them at most.
    """
    kept = stored(firsts.sparkSession, index)
    if kept is None:
        return firsts
    touched = [r[0] for r in firsts.select("prefix").distinct().collect()]
    known = kept.where(F.col("prefix").isin(touched) & (F.col("delivery") != str(delivery))).select("prefix", "key")
    return firsts.join(known, ["prefix", "key"], "left_anti")


def admit(
    df: DataFrame, index: str, delivery: str | int, text: str = "text", order: str = "pos", prefix_chars: int | None = None,
    digits: int = DIGITS,
) -> DataFrame:
    """One column, the order value of each row of a delivery that is kept, and its key added to the index.

    Kept is the first row of each near-duplicate key that no earlier delivery has had: deliveries admitted one
    after the other keep what one go over all of them, in that order, keeps. A delivery that is repeated gives
    the same rows and leaves the index as it was. Rows without a text are not kept. One delivery at a time.
    """
    firsts = staged(first_keys(df, near_duplicate_key(F.col(text), prefix_chars), order, digits), "firsts")
    new = staged(against(firsts, index, delivery), "admitted")
    rows = new.select("key", "prefix", F.lit(str(delivery)).alias("delivery")).repartition("prefix")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix", "delivery").parquet(index)
    return new.select(order)


def admitted_rows(
    df: DataFrame, index: str, delivery: str | int, text: str = "text", order: str = "pos", prefix_chars: int | None = None,
    digits: int = DIGITS,
) -> DataFrame:
    """The kept rows of a delivery whole; ``order`` tells its rows apart. Texts are not shuffled with the keys:
    only the kept order values are joined to the rows."""
    return df.join(admit(df, index, delivery, text, order, prefix_chars, digits), order, "left_semi")
