"""Classifier quality: confusion counts, rank metrics and latencies, overall and by slice.

Scored rows have ``label``, ``pred``, ``score`` and, where measured, ``latency_ms``; ``source``
and ``lang`` name the slices, ``tbl`` the evaluated table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.scores import safe_div
from textward.operators import ranks
from textward.session import staged

SLICE = ["tbl", "dimension", "value"]


def with_defaults(df: DataFrame, tbl: str = "all") -> DataFrame:
    """Absent source and lang become "unknown" (nulls in present columns stay)."""
    for name, default in (("source", "unknown"), ("lang", "unknown"), ("tbl", tbl)):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default))
    return df


def in_slices(counted: DataFrame) -> DataFrame:
    """Each (tbl, source, lang) row three times: overall, by source, by language.

    Meant for rows already counted, so that what is tripled is small.
    """
    one = lambda d, v: F.struct(F.lit(d).alias("dimension"), v.cast("string").alias("value"))
    slices = F.array(one("overall", F.lit("all")), one("source", F.col("source")), one("lang", F.col("lang")))
    kept = [c for c in counted.columns if c not in ("source", "lang")]
    return counted.select(*kept, F.explode(slices).alias("__s")).select(
        *kept, F.col("__s.dimension").alias("dimension"), F.col("__s.value").alias("value")
    )


def confusion_counts(scored: DataFrame) -> DataFrame:
    """n, tp, fp, tn, fn per slice; a pair that is none of the first three counts as fn."""
    y, p = F.col("label"), F.col("pred")
    tp, fp, tn = (y == 1) & (p == 1), (y == 0) & (p == 1), (y == 0) & (p == 0)
    other = F.coalesce(~(tp | fp | tn), F.lit(True))
    base = with_defaults(scored).groupBy("tbl", "source", "lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(tp).alias("tp"),
        F.count_if(fp).alias("fp"),
        F.count_if(tn).alias("tn"),
        F.count_if(other).alias("fn"),
    )
    return in_slices(base).groupBy(*SLICE).agg(
        *[F.sum(c).alias(c) for c in ("n", "tp", "fp", "tn", "fn")]
    )


def precision(tp: Column, fp: Column) -> Column:
    return safe_div(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return safe_div(tp, tp + fn)


def f1(p: Column, r: Column) -> Column:
    return safe_div(2 * p * r, p + r)


def accuracy(tp: Column, tn: Column, n: Column) -> Column:
    return safe_div(tp + tn, n)


def with_ratios(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return (
        counts.withColumn("precision", precision(tp, fp))
        .withColumn("recall", recall(tp, fn))
        .withColumn("f1", f1(F.col("precision"), F.col("recall")))
        .withColumn("accuracy", accuracy(tp, tn, F.col("n")))
    )


def score_counts(scored: DataFrame) -> DataFrame:
    """Positives and negatives per (slice, score)."""
    known = with_defaults(scored).filter(F.col("score").isNotNull())
    base = known.groupBy("tbl", "source", "lang", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    return in_slices(base).groupBy(*SLICE, "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )


def ranked_scores(scored: DataFrame) -> DataFrame:
    """``score_counts`` with the positives and negatives below each score and in the slice."""
    counted = staged(score_counts(scored), "score-counts")
    return ranks.running_totals(counted, SLICE, "score", ["pos", "neg"])


def auc(ranked: DataFrame) -> DataFrame:
    """ROC-AUC by mid-ranks and average precision per slice; null when a class is absent.

    A score's rows share the mean of their ranks. For the precision at a score, all rows of that
    score or more count as predicted positive.
    """
    pos, neg = F.col("pos"), F.col("neg")
    below = F.col("pos_below") + F.col("neg_below")
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    # Twice the rank sum is a whole number, so the sum is exact in any order.
    twice_ranks = F.sum((pos * (2 * below + pos + neg + 1)).cast("decimal(38,0)"))
    grouped = ranked.groupBy(*SLICE).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        twice_ranks.alias("r2"),
        F.sum(F.when(pos > 0, pos * tp / (tp + fp)).otherwise(0.0)).alias("precisions"),
    )
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    two_classes = (F.col("p") > 0) & (F.col("n") > 0)
    return grouped.select(
        *SLICE,
        F.when(two_classes, (F.col("r2").cast("double") - p * (p + 1)) / 2 / (p * n)).alias("roc_auc"),
        F.when(two_classes, F.col("precisions") / p).alias("pr_auc"),
    )


def latencies(scored: DataFrame) -> DataFrame:
    """Mean and 95th-percentile latency per slice, 0.0 where none was measured."""
    base = with_defaults(scored).groupBy("tbl", "source", "lang", "latency_ms").agg(
        F.count(F.lit(1)).alias("k")
    )
    counted = staged(
        in_slices(base).groupBy(*SLICE, "latency_ms").agg(F.sum("k").alias("k")), "latency-counts"
    )
    known = F.col("latency_ms").isNotNull()
    means = counted.groupBy(*SLICE).agg(
        F.coalesce(
            F.sum(F.when(known, F.col("latency_ms") * F.col("k"))) / F.sum(F.when(known, F.col("k"))),
            F.lit(0.0),
        ).alias("mean_latency_ms")
    )
    placed = ranks.running_totals(counted.filter(known), SLICE, "latency_ms", ["k"])
    at = ranks.p95_rank(F.col("k_total"))
    picked = placed.filter((F.col("k_below") <= at) & (at < F.col("k_below") + F.col("k"))).select(
        *SLICE, F.col("latency_ms").alias("p95_latency_ms")
    )
    return by_keys(means, picked, SLICE).select(
        *SLICE, "mean_latency_ms", F.coalesce("p95_latency_ms", F.lit(0.0)).alias("p95_latency_ms")
    )


def threshold_sweep(ranked: DataFrame) -> DataFrame:
    """Per slice, the lowest score to flag that gives the best F1, and what it gives.

    Every score present is tried as "flag this score and above"; the highest wins a tie.
    """
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    f1_here = safe_div(2 * tp, F.col("pos_total") + tp + fp)
    best = F.max(F.struct(f1_here.alias("f1"), F.col("score"), tp.alias("tp"), fp.alias("fp")))
    return ranked.groupBy(*SLICE).agg(best.alias("b")).select(
        *SLICE, F.col("b.score").alias("flag_from"), "b.f1", "b.tp", "b.fp"
    )


def labelled_accuracy(df: DataFrame, expected: Column, flagged: Column) -> DataFrame:
    """Cases, cases judged as expected, and their share."""
    right = F.count_if(flagged == expected)
    n = F.count(F.lit(1))
    return df.agg(n.alias("n"), right.alias("correct"), safe_div(right, n).alias("accuracy"))


def by_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on keys that may be null; the keys appear once."""
    renamed = right.select(
        *[F.col(c).alias(f"__{c}") for c in keys], *[c for c in right.columns if c not in keys]
    )
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(renamed, same, "left").drop(*[f"__{c}" for c in keys])
