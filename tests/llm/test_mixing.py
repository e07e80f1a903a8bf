from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textward.llm import mixing
from textward.llm.queries import QUERIES, sized, weighted_targets

from .conftest import SF


def plain_targets(sizes, weights, most=3.0):
    """Shares by weight; what is above a limit goes to the others, again and again."""
    left, capped = float(sum(sizes.values())), {}
    while True:
        rest = {s: w for s, w in weights.items() if s not in capped}
        if not rest:
            return capped
        share = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = most * sizes[s]
            left -= capped[s]


@pytest.mark.parametrize("sizes", [
    {"a": 1, "b": 100, "c": 10_000, "d": 3}, {"a": 0, "b": 5}, {"a": 0}, {"a": 7, "b": 7, "c": 7, "d": 7}, {"a": 2, "b": 2, "c": 1000, "d": 0, "e": 40},
])
def test_targets_are_the_fixed_point(spark, sizes):
    weights = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    df = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, w int")
    got = {r.source: r.target for r in mixing.source_targets(df, F.col("w")).collect()}
    assert got == pytest.approx(plain_targets(sizes, weights))


def test_query_keeps_its_promises(spark):
    rows = QUERIES["op2_mixing"](spark, SF).collect()
    by = defaultdict(list)
    source = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect())
    for r in rows:
        by[source[r.doc_id]].append(r)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    assert sum(max(r.target for r in part) for part in by.values()) == pytest.approx(sum(r.size for r in rows))
    for part in by.values():
        assert len({(r.target, r.source_size) for r in part}) == 1
        off = abs(sum(r.taken for r in part) - part[0].target)
        assert off <= max(r.size for r in part) / 2 + 1
        copies = {r.taken // r.size for r in part if r.size}
        assert max(copies) - min(copies) <= 1  # whole copies of all before any more of one
    assert sorted(rows) == sorted(QUERIES["op2_mixing"](spark, SF).collect())


def test_better_documents_come_first(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("long").alias("size"), F.lit(0).alias("text_hash"),
        F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.1).alias("q"),
    )
    targets = spark.createDataFrame([("s", 40_000, 8_000.0)], "source string, source_size long, target double")
    taken = mixing.mix(docs, targets, F.col("q")).where("copies = 1")
    good = taken.where("doc_id % 2 = 0").count()
    assert taken.count() == 800 and good > 640


def test_odd_rows(spark, odd, none):
    docs = sized(odd.drop("size"))
    mixed = mixing.mix(docs, weighted_targets(docs), F.col("quality")).collect()
    assert len(mixed) == 11
    assert {r.source for r in mixed} == {None, "", "a", "b", "c", "é"}
    assert all(r.copies == 0 or r["size"] > 0 or r.target == 0 for r in mixed)
    assert all(r.copies <= 3 for r in mixed)
    empty = sized(none.drop("size"))
    assert mixing.mix(empty, weighted_targets(empty), F.col("quality")).count() == 0


def test_slices_stay_small_for_any_weight(spark):
    """With weights of a sixth, a thousandth and none at all, no slice holds much of a source."""
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("hot").alias("source"), F.lit(10).cast("long").alias("size"))
    for weight in (1.0, 1 / 6, 0.001, 0.0):
        w = F.greatest(F.lit(weight), F.lit(1e-9))
        key = -F.ln(mixing.uniform(F.col("doc_id"), 7)) / w
        sizes = docs.groupBy(F.floor(F.ln(key) * mixing.SLICES)).count().agg(F.max("count")).first()[0]
        assert sizes < 60_000 / 500


def test_columns_of_the_result_s_names_are_replaced(spark):
    docs = spark.createDataFrame([(i, "a", 10, i, 1.0, "x") for i in range(20)], "doc_id long, source string, size long, text_hash long, target double, copies string")
    targets = mixing.source_targets(mixing.source_sizes(docs), F.lit(1))
    out = mixing.mix(docs.withColumn("source_size", F.lit("y")), targets)
    assert sorted(out.columns) == sorted(["doc_id", "source", "size", "text_hash", "source_size", "target", "copies"])
    assert out.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] == 200
