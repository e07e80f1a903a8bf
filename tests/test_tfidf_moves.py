"""Term weights: documents are told by id wherever their rows are, and little moves for it."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textward.operators import tfidf


@pytest.mark.parametrize("small", [200_000, 0])
def test_rows_of_an_id_count_once(spark, monkeypatch, small):
    monkeypatch.setattr(tfidf, "SMALL", small)
    rows = [(1, "a b"), (1, "a c"), (2, "a a"), (None, "c"), (None, "c d"), (3, None), (4, ""), (5, "d")]
    got = {r.term: r.idf for r in tfidf.fit(spark.createDataFrame(rows, "id long, text string").repartition(5), "id").collect()}
    want = Counter(w for i in {i for i, _ in rows} for w in {w for j, t in rows if j == i for w in (t or "").split()})
    lone = spark.createDataFrame([(n,) for n in want.values()], "n int").select(
        "n", (F.ln(F.lit(1.0 + len(rows)) / (F.col("n") + 1)) + 1).alias("idf")
    )
    idf = {r.n: r.idf for r in lone.collect()}
    assert got == {w: idf[n] for w, n in want.items()}


def test_texts_of_ids_that_come_once_do_not_move(spark):
    docs = spark.createDataFrame([(i, f"a b{i} c") for i in range(20)], "id long, text string")
    plan = tfidf.fit(docs, "id")._jdf.queryExecution().executedPlan().toString()
    # Terms alone, as counts, were a second exchange after that of the texts.
    assert plan.count("Exchange") == 1


def test_weights_of_many_terms_are_joined_once(spark, monkeypatch):
    """By term, and back by id: the idf is there, and what is grouped by id stays."""
    monkeypatch.setattr(tfidf, "SMALL", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, f"a b{i} c") for i in range(20)], "id long, text string")
        weights = tfidf.weights(docs, tfidf.fit(docs, "id"), "id").groupBy("id").agg(F.sum(F.col("idf") * F.col("n")))
        plan = weights._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(id") == 2 and plan.count("Exchange hashpartitioning(term") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
