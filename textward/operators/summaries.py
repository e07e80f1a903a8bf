"""Counts over corpora and decision logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_summary(df: DataFrame) -> DataFrame:
    """Rows per split: in total, by source, by language and by label.

    Counted once per (split, source, lang, label); the grouping sets then run over those counts.
    """
    counted = df.groupBy("split", "source", "lang", "label").agg(F.count(F.lit(1)).alias("k"))
    sets = counted.groupingSets(
        [["split"], ["split", "source"], ["split", "lang"], ["split", "label"]],
        "split", "source", "lang", "label",
    ).agg(
        F.sum("k").alias("n"),
        F.grouping("source").alias("no_source"),
        F.grouping("lang").alias("no_lang"),
        F.grouping("label").alias("no_label"),
    )
    by = lambda name: F.col(f"no_{name}") == 0
    return sets.select(
        "split",
        F.when(by("source"), "by_source").when(by("lang"), "by_lang").when(by("label"), "by_label")
        .otherwise("total").alias("dimension"),
        F.when(by("source"), F.col("source")).when(by("lang"), F.col("lang"))
        .when(by("label"), F.col("label").cast("string")).otherwise("all").alias("value"),
        "n",
    )


def source_stats(rows: DataFrame) -> DataFrame:
    """Per source: rows after the filter, kept, skipped, and kept by label."""
    kept = F.col("kept")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("raw_rows_after_filter"),
        F.count_if(kept).alias("kept_rows"),
        F.count_if(~kept).alias("skipped_rows"),
        F.count_if(kept & (F.col("label") == 0)).alias("n_label_0"),
        F.count_if(kept & (F.col("label") == 1)).alias("n_label_1"),
    )


def label_counts(rows: DataFrame) -> DataFrame:
    """Kept rows per source and label, whatever labels there are."""
    return rows.filter("kept").groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))


def decision_counts(log: DataFrame) -> DataFrame:
    """One row: total, allowed, blocked, dropped, errors, mean total latency.

    The mean leaves out entries without a latency and is 0.0 when there are none.
    """
    is_ = lambda d: F.count_if(F.col("decision") == d)
    aggregates = [
        F.count(F.lit(1)).alias("total"),
        is_("ALLOWED").alias("allowed"),
        is_("BLOCKED").alias("blocked"),
        is_("DROPPED").alias("dropped"),
        is_("ERROR").alias("errors"),
    ]
    if "total_latency_ms" in log.columns:
        aggregates.append(
            F.coalesce(F.round(F.avg("total_latency_ms"), 3), F.lit(0.0)).alias("average_total_latency_ms")
        )
    return log.agg(*aggregates)


def blocked_by(log: DataFrame) -> DataFrame:
    """How many entries each classifier blocked or dropped."""
    return (
        log.select("decision", F.explode("failed_filters").alias("filter_name"))
        .groupBy("filter_name", "decision")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def stratum_count(df: DataFrame) -> DataFrame:
    """Distinct (source, lang) pairs among negatives."""
    return df.filter(F.col("label") == 0).agg(
        F.count_distinct(F.struct("source", "lang")).alias("strata")
    )
