"""Term weights and Newton's method against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textward.operators import logistic, tfidf

TEXTS = ["the cat, the dog", "the bird", "", None, "Cat cat CAT 7", "él él bird the", "!!"]


def plain_weights(texts, fitted_on):
    counts = [Counter(re.findall(r"[^\W_]+", (t or "").lower())) for t in fitted_on]
    idf = {w: math.log((1 + len(fitted_on)) / (1 + sum(w in c for c in counts))) + 1 for c in counts for w in c}
    out = {}
    for i, t in enumerate(texts):
        raw = {w: n * idf[w] for w, n in Counter(re.findall(r"[^\W_]+", (t or "").lower())).items() if w in idf}
        length = math.sqrt(sum(x * x for x in raw.values()))
        out |= {(i, w): x / length for w, x in raw.items()}
    return out


def test_weights(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    idf = tfidf.fit(docs, "id")
    more = [*TEXTS, "an unknown cat"]
    got = tfidf.weights(spark.createDataFrame(list(enumerate(more)), "id long, text string"), idf, "id").collect()
    want = plain_weights(more, TEXTS)
    assert {(r["id"], r["term"]) for r in got} == set(want)
    assert all(math.isclose(r["weight"], want[r["id"], r["term"]], rel_tol=1e-12) for r in got)
    assert tfidf.fit(docs.limit(0), "id").count() == 0
    assert {r["term"] for r in tfidf.fit(docs, "id", at_least=2).collect()} == {"the", "cat", "bird"}


def rows_of(n, d, seed, apart=1.5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.linspace(0.2, 3, d)
    y = (x @ rng.normal(size=d) * apart + rng.logistic(size=n) > 0).astype(int)
    return x, y


@pytest.mark.parametrize("n,d,penalty", [(400, 5, 1.0), (60, 12, 0.1), (300, 3, 10.0)])
def test_the_gradient_vanishes_and_weights_are_the_minimum(spark, n, d, penalty):
    x, y = rows_of(n, d, n)
    df = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, y int").repartition(4)
    head = logistic.fit(df, "x", "y", penalty)
    assert head.converged and len(head.weights) == d + 1
    parts = {r["place"]: r["gradient"] for r in logistic.gradient(df, head, "x", "y", penalty).collect()}
    assert set(parts) == set(range(d + 1)) and max(map(abs, parts.values())) <= 1e-7 * n

    def loss(w):
        z = x @ w[:-1] + w[-1]
        return np.sum(np.logaddexp(0, z) - y * z) + penalty / 2 * np.sum(w[:-1] ** 2)

    w, rng = np.array(head.weights), np.random.default_rng(1)
    assert all(loss(w) <= loss(w + rng.normal(size=d + 1) * 1e-2) for _ in range(200))
    scores = df.select(head.score(F.col("x")).alias("s"), "x").collect()
    assert all(math.isclose(r["s"], 1 / (1 + math.exp(-(np.dot(r["x"], w[:-1]) + w[-1]))), rel_tol=1e-9) for r in scores)


def test_rows_that_teach_nothing(spark):
    rows = [([1.0, 2.0], 1), ([0.0, 1.0], 0), ([2.0, 1.0], 1), (None, 1), ([1.0], 0), ([float("nan"), 1.0], 0), ([1.0, None], 1), ([1.0, 1.0], None), ([1.0, 1.0], 3)]
    df = spark.createDataFrame(rows, "x array<double>, y int")
    sound = spark.createDataFrame(rows[:3], "x array<double>, y int")
    a, b = logistic.fit(df, "x", "y"), logistic.fit(sound, "x", "y")
    assert np.allclose(a.weights, b.weights, atol=1e-9) and a.converged
    with pytest.raises(ValueError):
        logistic.fit(df.limit(0), "x", "y")
    none = logistic.fit(df.where("y is null"), "x", "y")
    assert not none.converged and set(none.weights) == {0.0}
