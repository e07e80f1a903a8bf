"""Exact-count sampling inside strata, ordered by a seeded hash.

A sample of the first K rows of a stratum in hash order is found without ever sorting a
stratum. Rows are counted per (stratum, hash bucket); running counts over the buckets, at most
``2 ** BUCKET_BITS`` per stratum, say which bucket holds the K-th row; only that bucket's rows
are ranked, which gives the K-th hash. Every row then compares its own hash with that cut. A
stratum holding a third of all rows is spread evenly over its buckets at every step, and no step
but the last touches more than the stratum columns and the hash. The counts and the cuts are
written to the shared folder, so each pass over the rows happens once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.functions.planning import evaluate_here
from textward.session import staged

BUCKET_HEX_DIGITS = 3  # 4096 buckets per stratum


def seeded_hash(seed: int | str, order: str) -> Column:
    """Hex SHA-256 of ``seed|order value``: the sampling order, the same on every run."""
    return evaluate_here(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(order).cast("string")), 256))


def _bucket(hash_column: str) -> Column:
    return F.substring(F.col(hash_column), 1, BUCKET_HEX_DIGITS)


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return test


Quota = Callable[[Column], Column]


def cut_table(
    df: DataFrame, strata: Sequence[str], hash_column: str, quotas: dict[str, Quota]
) -> DataFrame:
    """One row per stratum with ``cut_<quota>``, the last hash inside each quota.

    A quota maps a stratum's size to a number of rows. Its cut is null where that is 0 or less,
    and the stratum's last hash where it covers the whole stratum.
    """
    strata = list(strata)
    narrow = df.select(*strata, F.col(hash_column).alias("__h"), _bucket(hash_column).alias("__b"))
    per_bucket = narrow.groupBy(*strata, "__b").agg(
        F.count(F.lit(1)).alias("__n"), F.max("__h").alias("__last")
    )
    # At most 4096 rows per stratum from here on, so these windows stay small whatever the data.
    within = Window.partitionBy(*strata)
    before = within.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        staged(per_bucket, "bucket-counts")
        .select(
            "*",
            F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"),
            F.sum("__n").over(within).alias("__total"),
        )
        .select("*", *[quota(F.col("__total")).cast("bigint").alias(f"__k_{q}") for q, quota in quotas.items()])
    )

    # The bucket in which a quota ends, and which of its rows is the last to fit.
    def last_row(q: str) -> Column:
        k = F.col(f"__k_{q}")
        inside = (k > F.col("__before")) & (k <= F.col("__before") + F.col("__n"))
        return F.when(inside, F.struct(F.lit(q).alias("quota"), (k - F.col("__before")).alias("row")))

    ending = counts.select(
        *strata, "__b", F.array_compact(F.array(*[last_row(q) for q in quotas])).alias("__ends")
    ).filter(F.size("__ends") > 0)
    ranked = (
        narrow.alias("n")
        .join(ending.alias("e"), _same("n", "e", [*strata, "__b"]))
        .select(*[F.col(f"n.{c}").alias(c) for c in [*strata, "__b", "__h"]], "e.__ends")
        .withColumn("__rank", F.row_number().over(Window.partitionBy(*strata, "__b").orderBy("__h")))
    )
    hits = ranked.select(*strata, "__h", "__rank", F.explode("__ends").alias("__end")).filter(
        F.col("__rank") == F.col("__end.row")
    )
    ended = hits.groupBy(*strata).agg(
        *[F.max(F.when(F.col("__end.quota") == q, F.col("__h"))).alias(f"__cut_{q}") for q in quotas]
    )
    whole = counts.groupBy(*strata).agg(
        *[F.max(F.when(F.col(f"__k_{q}") >= F.col("__total"), F.col("__last"))).alias(f"__whole_{q}") for q in quotas]
    )
    cuts = (
        whole.alias("w")
        .join(ended.alias("e"), _same("w", "e", strata), "left")
        .select(
            *[F.col(f"w.{c}").alias(c) for c in strata],
            *[F.coalesce(F.col(f"w.__whole_{q}"), F.col(f"e.__cut_{q}")).alias(f"cut_{q}") for q in quotas],
        )
    )
    return staged(cuts, "cuts")


def with_cuts(df: DataFrame, strata: Sequence[str], cuts: DataFrame, how: str = "inner") -> DataFrame:
    """The rows with the cuts of their stratum; with ``left``, rows of strata without cuts too.

    The cuts, one row per stratum, have been written, so the planner knows their size: it sends few
    of them to every task and joins many by stratum, where a hot stratum's rows are split as skew.
    """
    names = [c for c in cuts.columns if c.startswith("cut_")]
    return (
        df.alias("r")
        .join(cuts.alias("t"), _same("r", "t", strata), how)
        .select(*[F.col(f"r.{c}").alias(c) for c in df.columns], *[F.col(f"t.{c}") for c in names])
    )


# ---- balancing ----------------------------------------------------------------------------------


def check_ratio(target_ratio: float) -> float:
    if not 0.0 < float(target_ratio) < 1.0:
        raise ValueError(f"target ratio must be strictly between 0 and 1, got {target_ratio}")
    return float(target_ratio)


def desired_negatives(positives: int, target_ratio: float) -> int:
    """Negatives that make the positives ``target_ratio`` of all rows, half to even."""
    r = check_ratio(target_ratio)
    return int(round(positives * (1.0 - r) / r))


@dataclass(frozen=True)
class ClassBalance:
    """The two class sizes of a corpus and what the target ratio makes of them."""

    positives: int
    negatives: int
    desired: int

    @property
    def both(self) -> bool:
        return self.positives > 0 and self.negatives > 0

    @property
    def subsample(self) -> bool:
        return self.both and self.negatives > self.desired


def class_balance(df: DataFrame, target_ratio: float) -> ClassBalance:
    """Counts both classes; two numbers come back to the driver."""
    n = df.agg(
        F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")
    ).first()
    return ClassBalance(n["n1"], n["n0"], desired_negatives(n["n1"], target_ratio))


def balance(
    df: DataFrame, target_ratio: float = 0.6, seed: int = 7, order: str = "pos"
) -> DataFrame:
    """All positives and enough negatives for the ratio, the latter a sample by (source, lang).

    A stratum keeps its rounded share of the wanted negatives, at least one row; if the shares
    add up to more than wanted, the last rows in hash order go. Negatives are never added. With
    one class absent nothing changes; with both, rows of any other label go.
    """
    strata, label = ["source", "lang"], F.col("label")
    hashed = df.withColumn("__hash", seeded_hash(seed, order))
    # What decides is narrow and is written once; the rows themselves are read once more, at the end.
    narrow = staged(hashed.filter(label.isin(0, 1)).select(*strata, "label", "__hash"), "balance")
    n = class_balance(narrow, target_ratio)
    if not n.both:
        return df
    if not n.subsample:
        return df.filter(label.isin(0, 1))

    def share(size: Column) -> Column:
        rounded = F.bround(F.lit(n.desired) * (size.cast("double") / F.lit(n.negatives)))
        return F.least(size, F.greatest(F.lit(1), rounded.cast("bigint")))

    negatives = narrow.filter(label == 0)
    shares = cut_table(negatives, strata, "__hash", {"share": share})
    drawn = with_cuts(negatives, strata, shares).filter(F.col("__hash") <= F.col("cut_share"))
    # The last hash among the wanted number of drawn rows: one value for the whole job.
    last = (
        cut_table(
            drawn.select("__hash", F.lit(0).alias("__one")),
            ["__one"],
            "__hash",
            {"total": lambda size: F.least(size, F.lit(n.desired))},
        )
        .agg(F.max("cut_total"))
        .first()[0]
    )
    kept = (label == 1) | ((label == 0) & (F.col("__hash") <= F.least(F.col("cut_share"), F.lit(last))))
    return with_cuts(hashed, strata, shares, "left").filter(kept).select(*df.columns)


def balance_stats(before: DataFrame, after: DataFrame, target_ratio: float = 0.6) -> DataFrame:
    """One row: kept positives and negatives, whether subsampled, wanted negatives, strata.

    The wanted number and the strata are null where the job did not need them.
    """
    n = class_balance(before, target_ratio)
    kept = after.agg(
        F.count_if(F.col("label") == 1).alias("kept_pos"),
        F.count_if(F.col("label") == 0).alias("kept_neg"),
    )
    strata = before.filter(F.col("label") == 0).agg(F.count_distinct(F.struct("source", "lang")))
    return kept.select(
        "kept_pos",
        "kept_neg",
        F.lit(n.subsample).alias("subsampled"),
        F.lit(n.desired if n.both else None).cast("bigint").alias("desired_neg"),
        (strata.scalar() if n.subsample else F.lit(None).cast("bigint")).alias("neg_strata"),
    )


# ---- splitting ----------------------------------------------------------------------------------


def split(
    df: DataFrame,
    seed: int = 7,
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
    strata: Sequence[str] = ("source", "label"),
    order: str = "pos",
) -> DataFrame:
    """Adds ``split`` in {train, val, test}, exact counts within each stratum.

    train and val take their rounded shares, half to even; test takes what is left.
    """
    if abs(sum(ratios) - 1.0) >= 1e-6:
        raise ValueError(f"ratios must add up to 1, got {ratios}")
    train_n = lambda n: F.bround(n.cast("double") * ratios[0]).cast("bigint")
    val_n = lambda n: F.bround(n.cast("double") * ratios[1]).cast("bigint")
    hashed = df.withColumn("__hash", seeded_hash(f"{seed}-split", order))
    quotas = {"train": train_n, "val": lambda n: F.least(n, train_n(n) + val_n(n))}
    narrow = staged(hashed.select(*strata, "__hash"), "split")
    cut = with_cuts(hashed, strata, cut_table(narrow, strata, "__hash", quotas))
    return cut.withColumn(
        "split",
        F.when(F.col("__hash") <= F.col("cut_train"), "train")
        .when(F.col("__hash") <= F.col("cut_val"), "val")
        .otherwise("test"),
    ).drop("__hash", "cut_train", "cut_val")


def shuffled_within(df: DataFrame, group: str, seed: int = 7, order: str = "pos") -> DataFrame:
    """The rows in partitions that follow one another in shuffled order within each group: written, the files
    of a group hold its rows in that order. Ranges of groups and hashes, so a large group takes many tasks."""
    hashed = df.withColumn("__order", seeded_hash(f"{seed}-order", order))
    return hashed.repartitionByRange(group, "__order").sortWithinPartitions(group, "__order").drop("__order")


def shuffled(df: DataFrame, seed: int = 7, order: str = "pos") -> DataFrame:
    """The rows in an order that has nothing to do with where they came from."""
    return df.withColumn("__order", seeded_hash(f"{seed}-order", order)).orderBy("__order").drop("__order")
