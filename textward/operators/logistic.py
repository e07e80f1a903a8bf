"""A logistic regression on dense features by Newton's method: Spark adds up Gram matrices, round by round."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Features at most: what comes to the driver each round is the square of it.
MOST_FEATURES = 1024


@dataclass(frozen=True)
class Head:
    """Weights of the features, the last one of a constant."""

    weights: tuple[float, ...]
    rounds: int
    converged: bool

    def score(self, features: Column) -> Column:
        """The probability of class 1, in expressions; null if there are no features or as many others."""
        w = F.array(*[F.lit(x) for x in self.weights[:-1]])
        product = F.aggregate(F.zip_with(features.cast("array<double>"), w, lambda x, y: x * y), F.lit(self.weights[-1]), lambda s, x: s + x)
        return F.when(F.size(features) == len(self.weights) - 1, 1 / (1 + F.exp(-product)))


def _sums(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gradient, Hessian) of the log loss at the weights, summed over all rows."""
    d = len(weights)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d - 1)
                x = np.hstack([x, np.ones((batch.num_rows, 1))])
                y = batch.column(1).to_numpy(zero_copy_only=False)
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -700, 700)))
                total[:, 0] += x.T @ (p - y)
                total[:, 1:] += (x * (p * (1 - p))[:, None]).T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((d, d + 1))
    for i, j, v in rows.mapInArrow(add, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return out[:, 0], out[:, 1:]


def fit(
    df: DataFrame, features: str, label: str, penalty: float = 1.0, rounds: int = 30, tolerance: float = 1e-8
) -> Head:
    """Weights that minimise log loss plus ``penalty`` / 2 times the squared weights, the constant's left out.

    A round reads the rows once and adds a matrix of fixed size per task; the step is halved while it does not
    lessen the gradient. It ends when no part of the gradient is above ``tolerance`` per row. Rows without a
    label of 0 or 1, or with features that are null, not finite or of another number than most, are left out.
    """
    sizes = df.groupBy(F.size(features).alias("n")).agg(F.count(F.lit(1)).alias("k")).where("n > 0")
    found = sizes.orderBy(F.desc("k"), "n").first()
    if found is None:
        raise ValueError("no row has features")
    if found["n"] > MOST_FEATURES:
        raise ValueError(f"{MOST_FEATURES} features at most, these are {found['n']}")
    numbers = F.col(features).cast("array<double>")
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where((F.size(features) == found["n"]) & sound & F.col(label).isin(0, 1)).select(
        numbers.alias("x"), F.col(label).cast("double").alias("y")
    )
    n, d = rows.count(), found["n"] + 1
    shrink = np.full(d, penalty)
    shrink[-1] = 0.0
    weights = np.zeros(d)

    def at(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = _sums(rows, w)
        return g + shrink * w, h + np.diag(shrink + 1e-12)

    gradient, hessian = at(weights)
    for done in range(rounds):
        if not n or np.abs(gradient).max() <= tolerance * n:
            return Head(tuple(weights.tolist()), done, bool(n))
        step = np.linalg.solve(hessian, gradient)
        for _ in range(20):
            tried = weights - step
            g, h = at(tried)
            if np.linalg.norm(g) < np.linalg.norm(gradient):
                break
            step = step / 2
        weights, gradient, hessian = tried, g, h
    return Head(tuple(weights.tolist()), rounds, bool(np.abs(gradient).max() <= tolerance * n))


def gradient(df: DataFrame, head: Head, features: str, label: str, penalty: float = 1.0) -> DataFrame:
    """(place, gradient) of the penalised loss at the head's weights, in expressions alone; the constant is last.

    What ``fit`` promises can be held against it: every part is near zero.
    """
    x = F.concat(F.col(features).cast("array<double>"), F.array(F.lit(1.0)))
    off = df.select(F.posexplode(x).alias("place", "x"), (head.score(F.col(features)) - F.col(label)).alias("off"))
    pulled = F.get(F.array(*[F.lit(penalty * w) for w in head.weights[:-1]], F.lit(0.0)), F.col("place"))
    return off.groupBy("place").agg(F.sum(F.col("x") * F.col("off")).alias("g")).select("place", (F.col("g") + pulled).alias("gradient"))
