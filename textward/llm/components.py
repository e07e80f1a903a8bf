"""Connected components of a graph too large for one machine, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reached.

    Alternating star contraction: each round hooks a node's larger neighbours, then its smaller
    ones, to the smallest node around it. The number of links never grows, and the rounds needed
    grow with the logarithm of the longest chain. Minima are aggregated before the shuffle and the
    joins are plain equi-joins, so a hub with very many links is split by skew handling. Each
    round's links are written to the shared folder: a lost executor costs one round at most.

    Nulls and links of a node with itself are ignored; an empty table gives an empty table.
    """
    kind = links.schema["a"].dataType
    edges = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while state[0]:
        edges = staged(_small_star(_large_star(edges)), "links")
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    # Now every link leads from a node to the smallest one of its component.
    return edges.select(F.col("u").alias("node"), F.col("v").cast(kind).alias("component")).union(
        edges.select("v", "v").distinct()
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        around.where("v > u").join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hooked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hooked.union(least.select("u", F.col("m").alias("v"))).distinct()
