"""Evaluating classifiers on labelled tables, and choosing between them."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from textward.functions.planning import evaluate_here
from textward.operators import ensemble as E
from textward.operators import metrics as M
from textward.session import staged

logger = logging.getLogger("textward")

# The promotion gate.
MIN_F1 = 0.85
MIN_GAIN = 0.10
MIN_SOURCES_GAINED = 2


def read_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """The tables that exist; a missing one is skipped with a warning."""
    found = {}
    for name, path in paths.items():
        try:
            found[name] = spark.read.parquet(path)
        except AnalysisException as exc:
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            logger.warning("missing %s; skipping", path)
    return found


def first_rows(df: DataFrame, limit: int | None, order: str = "pos") -> DataFrame:
    """The first rows in order; no limit or 0 means all."""
    return df.orderBy(order).limit(limit) if limit else df


def predictions(df: DataFrame, spec: E.ClassifierSpec, text: str = "text") -> DataFrame:
    """Adds ``pred``, ``score`` and ``latency_ms``; rows the classifier failed on are left out."""
    scored = df.withColumn("__result", evaluate_here(E.classify(spec, F.col(text))))
    result = F.col("__result")
    return scored.filter(result["confidence"].isNotNull()).select(
        *df.columns,
        E.as_prediction(result)["pred"].alias("pred"),
        result["confidence"].alias("score"),
        result["latency_ms"].alias("latency_ms"),
    )


def union_tables(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [
        M.with_defaults(df.drop("tbl"), tbl=name).select(
            "tbl", "source", "lang", "label", "pred", "score", "latency_ms"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def evaluate(scored: DataFrame) -> DataFrame:
    """One row per (table, slice): counts, ratios, AUCs and latencies, unrounded.

    The scored rows are staged first, narrow, because scoring is what costs most and four
    aggregations read them.
    """
    columns = [c for c in ("tbl", "source", "lang", "label", "pred", "score", "latency_ms") if c in scored.columns]
    rows = staged(scored.select(*columns), "scored")
    report = M.with_ratios(M.confusion_counts(rows))
    report = M.by_keys(report, M.auc(M.ranked_scores(rows)), M.SLICE)
    return M.by_keys(report, M.latencies(rows), M.SLICE)


def rounded_report(report: DataFrame) -> DataFrame:
    """As displayed: ratios to four places, latencies to three, slices in order."""
    four = ["precision", "recall", "f1", "accuracy", "roc_auc", "pr_auc"]
    three = ["mean_latency_ms", "p95_latency_ms"]
    return report.select(
        *[c for c in report.columns if c not in four + three],
        *[F.round(c, 4).alias(c) for c in four],
        *[F.round(c, 3).alias(c) for c in three],
    ).orderBy("tbl", "dimension", "value")


def nested_report(report: DataFrame, classifier: str, limit: int | None = None) -> DataFrame:
    """One row with the JSON of a report: per table the overall metrics, and those by slice.

    ``report`` holds a few rows per table, one for each source and language.
    """
    shown = rounded_report(report)
    metrics = F.struct(
        F.col("accuracy"),
        F.struct(*sorted(["tp", "fp", "tn", "fn"])).alias("confusion"),
        *[F.col(c) for c in ("f1", "mean_latency_ms", "n", "p95_latency_ms", "pr_auc", "precision", "recall", "roc_auc")],
    )
    of = lambda d: F.col("dimension") == d
    by = lambda d: F.map_from_entries(
        F.sort_array(F.collect_list(F.when(of(d) & F.col("value").isNotNull(), F.struct("value", "m"))))
    )
    tables = shown.withColumn("m", metrics).groupBy("tbl").agg(
        F.first(F.when(of("overall"), F.col("m")), ignorenulls=True).alias("overall"),
        by("lang").alias("by_lang"),
        by("source").alias("by_source"),
    )
    entry = F.struct("by_lang", "by_source", "overall.*")
    by_name = lambda a, b: F.when(a["tbl"] < b["tbl"], -1).when(a["tbl"] > b["tbl"], 1).otherwise(0)
    named = F.array_sort(F.collect_list(F.struct("tbl", entry.alias("r"))), by_name)
    all_tables = tables.groupBy().agg(F.map_from_entries(named).alias("tables"))
    body = F.struct(
        F.lit(classifier).alias("classifier"), F.lit(limit).cast("int").alias("limit"), F.col("tables")
    )
    return all_tables.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def compare(
    spark: SparkSession, tables: dict[str, DataFrame], specs: dict[str, E.ClassifierSpec], name: str
) -> DataFrame:
    """The report of the classifier chosen by name over every table."""
    if name not in specs:
        raise ValueError(f"unknown classifier {name!r}; choose one of {sorted(specs)}")
    return evaluate(union_tables({t: predictions(df, specs[name]) for t, df in tables.items()}))


def bake_off(reports: dict[str, DataFrame], metric: str = "f1") -> DataFrame:
    """One row per slice, one column per classifier."""
    named = [df.select(F.lit(n).alias("classifier"), *M.SLICE, metric) for n, df in reports.items()]
    return (
        reduce(DataFrame.unionByName, named)
        .groupBy(*M.SLICE)
        .pivot("classifier", sorted(reports))
        .agg(F.first(metric))
    )


def promotion_gate(
    candidate: DataFrame,
    baseline: DataFrame,
    spanish_baseline: DataFrame,
    main_table: str,
    spanish_slice: tuple[str, str, str],
    sources: Sequence[str],
) -> DataFrame:
    """One row: the three criteria and the verdict.

    F1 on the main table; recall no lower than the Spanish baseline's on the Spanish slice, which
    holds when that slice has no rows; F1 up by ten points on at least two of the sources.
    """

    # Small results of costly scans, each read several times below.
    shared = spanish_baseline is baseline
    candidate, baseline = staged(candidate, "report"), staged(baseline, "report")
    spanish_baseline = baseline if shared else staged(spanish_baseline, "report")

    def pick(report: DataFrame, tbl: str, dimension: str, value: str, metric: str) -> Column:
        return (
            report.filter(
                (F.col("tbl") == tbl) & (F.col("dimension") == dimension) & (F.col("value") == value)
            )
            .agg(F.max(metric))
            .scalar()
        )

    slice_of = lambda report: report.filter(
        (F.col("tbl") == main_table) & (F.col("dimension") == "source") & F.col("value").isin(*sources)
    ).select("value", "f1")
    gained = (
        slice_of(candidate).withColumnRenamed("f1", "new_f1")
        .join(slice_of(baseline), "value")
        .agg(F.count_if(F.round(F.col("new_f1") - F.col("f1"), 9) >= MIN_GAIN).alias("sources_gained"))
    )
    now = pick(candidate, *spanish_slice, "recall")
    before = pick(spanish_baseline, *spanish_slice, "recall")
    return (
        gained.withColumn("f1", pick(candidate, main_table, "overall", "all", "f1"))
        .withColumn("f1_ok", F.coalesce(F.col("f1") >= MIN_F1, F.lit(False)))
        .withColumn("spanish_ok", F.coalesce(now >= before, F.lit(True)))
        .withColumn("gain_ok", F.col("sources_gained") >= MIN_SOURCES_GAINED)
        .withColumn("promoted", F.col("f1_ok") & F.col("spanish_ok") & F.col("gain_ok"))
    )
