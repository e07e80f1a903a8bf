"""Mixing sources to target weights: Efraimidis-Spirakis order within sources, filled to budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.llm.common import uniform
from textward.session import staged

# A source's documents are cut into slices by the logarithm of their key, so many to a unit; only the slice in
# which a budget ends is sorted. Whatever the scale of the weights, no slice has more than 1 / (e * SLICES) of
# the documents of one weight.
SLICES = 1024


def source_targets(sizes: DataFrame, weight: Column, most: float = 3.0) -> DataFrame:
    """(source, source_size, weight, target) for sources with their sizes.

    All targets together make up the total size. A target is its weight's share, but at most
    ``most`` times its source's size; what that cuts off goes to the others by weight, again and
    again until none is above. That fixed point has a closed form: ordered by size over weight,
    some first sources are at their limit and the rest share what is left at one level.
    One row per source goes through one sorted window, never a document.
    """
    limit = F.col("source_size") * F.lit(most)
    s = sizes.withColumn("weight", weight.cast("double")).withColumn("ratio", limit / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "capped": F.coalesce(F.sum(limit).over(before), F.lit(0.0)),
        "rest": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "total": F.sum("source_size").over(every).cast("double"),
    }).withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    # The first source whose limit is not below the level of all from it on ends the limited ones;
    # after it, levels only fall.
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
    return s.select(
        "source", "source_size", "weight",
        F.when(F.col("ratio") <= F.col("level"), limit)
        .otherwise(F.coalesce(F.col("level") * F.col("weight"), limit)).cast("double").alias("target"),
    )


def source_sizes(docs: DataFrame) -> DataFrame:
    """(source, source_size, place) of documents with a size; place is the rank by code point from 0,
    null last."""
    return (
        docs.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    )


def mix(docs: DataFrame, targets: DataFrame, quality: Column | float = 1.0, seed: int = 7) -> DataFrame:
    """Documents (doc_id, source, size, text_hash, ...) with ``source_size``, ``target`` and ``copies`` to take, in
    place of columns so called.

    A source whose target is k times its size and more is taken k times whole; the remainder is a
    sample without replacement. Its order is Efraimidis and Spirakis': a key -ln(u) / w, u a random
    number from doc_id, w the document's quality weight, smallest first. The sizes are summed in
    that order, and a document is taken while the remainder reaches over half of it: so the sample
    ends within half a document of its budget.

    No source is sorted whole. Keys fall into slices; sums per (source, slice) give the slice in which
    the budget ends, slices before it are taken, and only its own documents are ordered. The joined table has one row per source; it is written first, so that
    the planner knows its size. The documents are read twice: give them narrow, or written.

    A quality that is null or not above zero counts as the smallest weight: such documents come
    last. Documents without words are never taken in the sample but belong to whole copies. Equal
    doc_ids are ordered by size and hash of the text; rows equal in those too are alike and any of
    them may be the last one taken. Sources may be null. Reruns agree.
    """
    w = F.greatest(F.coalesce(F.lit(quality) if isinstance(quality, (int, float)) else quality, F.lit(0.0)), F.lit(1e-9))
    docs = docs.drop("source_size", "target", "copies")
    keyed = docs.withColumn("_key", -F.ln(uniform(F.col("doc_id"), seed)) / w).withColumn(
        "_slice", F.floor(F.ln("_key") * SLICES).cast("int")
    )
    t = targets.select(
        F.col("source").alias("_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("_epochs"),
    ).withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("source_size"))
    t = staged(t, "targets")
    sums = keyed.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    cuts = staged(
        sums.join(t, F.col("source").eqNullSafe(F.col("_source")))
        .where("_before <= _budget and _budget < _before + _sum")
        .select("_source", F.col("_slice").alias("_cut"), F.col("_before").alias("_cut_before")),
        "cuts",
    )
    levels = t.join(cuts.withColumnRenamed("_source", "_at"), F.col("_source").eqNullSafe(F.col("_at")), "left").drop("_at")
    levels = staged(levels, "levels")  # one row per source
    # The ordered slice: its documents and what stands before each.
    edge = keyed.join(levels, F.col("source").eqNullSafe(F.col("_source")))
    order = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size", "text_hash")
    inside = (
        edge.where("_slice = _cut")
        .withColumn("_ahead", F.col("_cut_before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    )
    outside = edge.where("_cut is null or _slice <> _cut").withColumn("_ahead", F.lit(None).cast("long"))
    taken = (
        F.when(F.col("_ahead").isNotNull(), F.col("_ahead") + F.col("size") / 2 <= F.col("_budget"))
        .when(F.col("_cut").isNotNull(), F.col("_slice") < F.col("_cut"))
        .otherwise(F.lit(False))
    ) & (F.col("size") > 0)
    return (
        inside.unionByName(outside)
        .withColumn("copies", (F.col("_epochs") + taken.cast("int")).cast("int"))
        .drop("_key", "_slice", "_source", "_epochs", "_budget", "_cut", "_cut_before", "_ahead")
    )

