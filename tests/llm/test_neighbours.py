import numpy as np
import pytest
from pyspark.sql import functions as F

from textward.llm import neighbours


def plain_nearest(vectors, queries, k):
    rows = set()
    for q in queries:
        scores = []
        for c, y in vectors.items():
            if c != q and len(y) == len(vectors[q]):
                total = 0.0
                for a, b in zip(vectors[q], y):
                    total += a * b
                scores.append((-total, c))
        rows |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(sorted(scores)[:k])}
    return rows


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 20)) * 10.0 ** rng.integers(-3, 4, (50, 1)), rng.normal(size=(60, 20))
    x8, xs, xe = neighbours.quantise(x)
    y8, ys, ye = neighbours.quantise(y)
    about = neighbours.int8_products(x8, y8) * xs[:, None] * ys
    bound = (np.linalg.norm(x, axis=1) + xe)[:, None] * ye + xe[:, None] * np.linalg.norm(y, axis=1)
    assert (np.abs(x @ y.T - about) <= bound * (1 + 1e-9)).all()


@pytest.mark.parametrize("query_block,candidate_block,k", [(1024, 4096, 5), (7, 11, 5), (7, 11, 500)])
def test_against_all_pairs(spark, monkeypatch, query_block, candidate_block, k):
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(neighbours, "CANDIDATE_BLOCK", candidate_block)
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=6).tolist() for i in range(60)}
    for i in range(60, 80):
        vectors[i] = vectors[i % 4]  # ties
    vectors |= {i: rng.normal(size=3).tolist() for i in range(80, 90)}  # other dimensions
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {tuple(r) for r in neighbours.nearest(neighbours.usable(df), F.col("id") % 10 == 0, k).collect()}
    assert got == plain_nearest(vectors, [i for i in vectors if i % 10 == 0], k)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], "a"), (1, None, "a"), (2, [], "a"), (3, [0.0, 0.0], "a"), (4, [1.0, None], None), (5, [nan, 1.0], "b"),
        (6, [inf, 1.0], "b"), (None, [1.0, 1.0], "b"), (7, [3.0, 1.0], "b"), (7, [3.0, 1.0], "b"), (8, [1e-310, 0.0], "b"), (9, [1e200, 1e200], "c"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, dims string")
    found = neighbours.usable(df)
    assert sorted(r.id for r in found.collect()) == [0, 7, 8, 9]
    got = neighbours.nearest(found, F.col("id") == 0, 20).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(9, 3e200), (7, 5.0), (8, 1e-310)]
    assert neighbours.nearest(found, F.col("id") == 1, 20).count() == 0
    assert neighbours.nearest(neighbours.usable(df.limit(0)), F.col("id") == 0, 20).count() == 0
