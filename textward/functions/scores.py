"""Score arithmetic and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.functions.planning import bind

# A score above these is shown as danger or as warning.
DANGER_ABOVE = 0.7
WARNING_ABOVE = 0.3
ROUTER_KEY = "input:Language Router"


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the largest for stability."""
    top = F.array_max(logits).cast("double")
    exps = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    return bind(
        F.struct(exps.alias("e"), F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x).alias("total")),
        lambda s: F.transform(s["e"], lambda x: x / s["total"]),
    )


def softmax_at(logits: Column, index: int) -> Column:
    """Element ``index`` of the softmax: one pass, no array of probabilities."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top))
    return F.exp(F.get(logits, F.lit(index)).cast("double") - top) / total


def clamp01(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def exceeds(score: Column, threshold: float) -> Column:
    """Strictly above: a score equal to the threshold passes."""
    return score > F.lit(float(threshold))


def safe_div(numerator: Column, denominator: Column) -> Column:
    """0.0 when the denominator is 0."""
    return F.when(denominator == 0, 0.0).otherwise(
        numerator.cast("double") / F.nullif(denominator, F.lit(0)).cast("double")
    )


def severity_band(score: Column) -> Column:
    return (
        F.when(score > DANGER_ABOVE, "danger").when(score > WARNING_ABOVE, "warning").otherwise("safe")
    )


def prefix_keys(scores: Column, prefix: str) -> Column:
    return F.transform_keys(scores, lambda k, _: F.concat(F.lit(prefix + ":"), k))


def merge_maps(first: Column, second: Column) -> Column:
    """Both maps' entries; ``second`` wins on shared keys, whatever the session's key policy."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def without_router(scores: Column) -> Column:
    """The scores to display: the router's own entry is left out."""
    return F.map_filter(scores, lambda k, _: k != ROUTER_KEY)


def percent(value: Column) -> Column:
    """``0.923`` as ``92.3%``."""
    return F.format_string("%.1f%%", value * 100)
