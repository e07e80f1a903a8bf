"""First-occurrence deduplication on exact text and on the near-duplicate key.

Looking at rows one by one in order, a row is dropped when its text or its key was kept before.
Equal texts have equal keys and only kept rows count as seen, so exactly the first row of each
key is kept; no order-dependent loop is needed. The key covers the whole text unless a number of
characters is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textward.functions.text import near_duplicate_key
from textward.session import staged


def _keyed(df: DataFrame, text: str, order: str, prefix_chars: int | None) -> DataFrame:
    return df.select(
        F.col(order).alias("pos"),
        near_duplicate_key(F.col(text), prefix_chars).alias("near_key"),
        F.sha2(F.col(text), 256).alias("text_hash"),
    )


def kept_positions(df: DataFrame, text: str = "text", order: str = "pos", prefix_chars: int | None = None) -> DataFrame:
    """One column, the order value of every kept row.

    Only key and order value are shuffled, after a hash aggregation on the map side, so copies
    of one text cost one row per task however many there are.
    """
    keys = df.select(F.col(order).alias(order), near_duplicate_key(F.col(text), prefix_chars).alias("near_key"))
    return keys.groupBy("near_key").agg(F.min(order).alias(order)).select(order)


def keep_first(df: DataFrame, text: str = "text", order: str = "pos", prefix_chars: int | None = None) -> DataFrame:
    """The kept rows whole.

    ``row_number() = 1`` lets Spark cut each task's rows to one per key before the shuffle, so a
    hot key brings at most one row per map task to its reducer. One scan, one shuffle.
    """
    first = Window.partitionBy("__near_key").orderBy(order)
    return (
        df.withColumn("__near_key", near_duplicate_key(F.col(text), prefix_chars))
        .withColumn("__rank", F.row_number().over(first))
        .filter(F.col("__rank") == 1)
        .drop("__near_key", "__rank")
    )


def key_table(
    df: DataFrame, *columns: str, text: str = "text", order: str = "pos", prefix_chars: int | None = None
) -> DataFrame:
    """(pos, near_key, text_hash) and the named columns of the rows, without their texts: both hashes of 256
    bits. Written once, it serves everything that follows from keys."""
    key = near_duplicate_key(F.col(text), prefix_chars).cast("binary")
    return df.select(
        F.col(order).alias("pos"), F.coalesce(F.unhex(F.sha2(key, 256)), F.lit(b"")).alias("near_key"),
        F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("text_hash"), *columns,
    )


def first_of_keys(keys: DataFrame) -> DataFrame:
    """The rows of a key table that are the first of their key.

    First positions are combined on the map side and only those of keys with several rows are joined, from a
    table that is written: both sides come by shuffles, so a key that very many rows share is split.
    """
    shared = keys.groupBy("near_key").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = staged(shared.drop("n"), "shared-keys")
    return keys.join(shared, "near_key", "left").filter("first_pos is null or pos = first_pos").drop("first_pos")


def collision_counts(df: DataFrame, text: str = "text", order: str = "pos", prefix_chars: int | None = None) -> DataFrame:
    """One row: rows before and after, exact and near collisions.

    Exact: dropped rows whose text is the kept one's. Near: the other dropped rows. Counted from
    (key, text) groups, whose sizes are combined on the map side.
    """
    return collisions_of(_keyed(df, text, order, prefix_chars))


def collisions_of(keys: DataFrame) -> DataFrame:
    """The counts of ``collision_counts`` from a key table."""
    per_text = (
        keys.groupBy("near_key", "text_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    )
    per_key = per_text.groupBy("near_key").agg(
        F.sum("n").alias("n"), F.min_by("n", "first_pos").alias("n_same_text")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return per_key.agg(
        total(F.col("n")).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        total(F.col("n_same_text") - 1).alias("exact_collisions"),
        total(F.col("n") - F.col("n_same_text")).alias("near_dup_collisions"),
    )


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the seen ones."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def seen_before(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key).distinct(), key, "left_semi")
