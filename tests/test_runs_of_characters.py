"""Counts of character runs against plain Python, and how little they and the term weights move."""

import random
from collections import Counter

from pyspark.sql import functions as F

from textward.operators import language_model as L
from textward.operators import tfidf


def plain_grams(text):
    plain = " " + " ".join(text.lower().split()) + " "
    return [plain[i : i + 3] for i in range(len(plain) - 2)]


def test_counts_of_any_characters(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é字😀\U0010ffff") for _ in range(n)) for n in (0, 1, 2, 3, 50, 400) for _ in range(60)] + [None, "", " "]
    rows = [(i % 100 if i % 7 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    got = {(r.key, r.gram): r.n for r in L.gram_counts(docs, F.col("id")).groupBy("key", "gram").agg(F.sum("n").alias("n")).collect()}
    want = Counter((i, g) for i, t in rows if t is not None for g in plain_grams(t))
    assert got == want
    sizes = [r[0] for r in docs.select(L.n_grams(F.col("text"))).collect()]
    assert sum(sizes) == sum(want.values())


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_terms_move_once(spark):
    """Texts are dealt by id; with a small vocabulary neither their terms nor their weights move after that."""
    docs = spark.createDataFrame([(i, f"a b{i} c") for i in range(20)], "id long, text string")
    weights = tfidf.weights(docs, tfidf.fit(docs, "id"), "id")
    assert exchanges(weights.groupBy("id").agg(F.sum("weight"))) == 1


def test_rows_of_one_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a"), (2, "b"), (None, "c")], "id long, text string")
    idf = tfidf.fit(docs, "id")
    got = {(r.id, r.term): r.n for r in tfidf.weights(docs, idf, "id").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1}


def test_prompt_files_grow_in_number(spark, tmp_path):
    """A table of many splits is written as many files, so that none grows with the table."""
    from verification import queries

    spark.range(0, 4000).selectExpr("id as doc_id", "repeat(cast(id as string), 50) as text").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        files = spark.read.text(queries._prompt_files(spark, str(tmp_path))).inputFiles()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(files) == 9
