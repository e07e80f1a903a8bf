import re
from collections import Counter

from pyspark.sql import functions as F

from textward.llm import rules
from textward.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"  # the smallest tables have too few labels to learn from


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", line)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    inside = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_query(spark):
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    label = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    rows = QUERIES["op5_quality_rules"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        got = tuple(r[n] for n in NAMES)
        assert got == plain_statistics(text[r.doc_id])
        assert r.base_failed == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert r.kept == (not r.base_failed and r.rule is None)
    good = [r for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if label.get(r.doc_id) == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(not r.kept for r in bad) >= 0.8 * len(bad)


def test_windows_that_overlap(spark):
    texts = ["a " * 20, "a b c d e f g h " * 2, " ".join("abcdefgh") + " x " + " ".join("abcdefgh"), "a b c d e f g", "x y " * 30 + "tail of other words here at the end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in rules.statistics(df).collect()}
    assert got == {i: plain_statistics(t)[4] for i, t in enumerate(texts)}


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 0), (99, 0), (6, None)], "doc_id long, quality int")
    judged, made = rules.judge(odd, labels)
    rows = judged.collect()
    assert len(rows) == 11 and not made.rules and set(odd.columns) <= set(judged.columns)
    assert all(tuple(r[n] for n in NAMES) == plain_statistics(r.text) for r in rows)
    assert not any(r.kept for r in rows if not r.text)
    assert rules.judge(odd, labels.limit(0))[0].count() == 11
    assert rules.judge(none, labels)[0].count() == 0


def test_a_list_is_learned_and_pruned(spark):
    """Rows are bad when symbols are many, or when words are long and few are different."""
    rows = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit(100).cast("long").alias("n_words"), (F.lit(400) + F.col("id") % 7 * 50).alias("word_chars"),
        (F.col("id") % 11 * 10).alias("n_symbols"), F.lit(0).alias("n_marks"), F.lit(3).alias("n_capitals"),
        (F.lit(20) + F.col("id") % 13 * 6).alias("n_distinct"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"),
    )
    bad = (F.col("n_symbols") > 80) | ((F.col("word_chars") > 600) & (F.col("n_distinct") <= 38))
    made = rules.Learner().learn(rows.withColumn("bad", bad.cast("int")))
    assert 2 <= len(made.rules) <= 8 and all(1 <= len(r) <= 3 for r in made.rules)
    wrong = rows.where(made.rule().isNotNull() != bad).count()
    assert wrong == 0, [list(map(str, r)) for r in made.rules]


def test_statistics_are_computed_once(spark, odd):
    """A filter on a statistic reads it and does not compute it again; columns keep their names."""
    docs = odd.withColumnRenamed("size", "_m").withColumnRenamed("lang", "made")
    made = rules.statistics(docs)
    assert made.columns[: len(docs.columns)] == docs.columns
    features = [F.expr(e).alias(f) for f, e in rules.FEATURES.items()]
    plan = made.where(~rules.base_failed()).select("doc_id", *features)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 3  # symbols, marks, capitals
