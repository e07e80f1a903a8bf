"""Deliveries admitted one after the other keep what one go keeps."""

import os
import random

import pytest
from pyspark.sql import functions as F

from textward.operators import key_index

SCHEMA = "pos long, text string"


def plain_kept(deliveries):
    seen, kept = set(), []
    for rows in deliveries:
        for pos, text in sorted(rows):
            if text is not None and text.lower().strip() not in seen:
                seen.add(text.lower().strip())
                kept.append(pos)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_deliveries_against_one_go(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = [f"text {i}" for i in range(120)] + ["", " ", None, "HOT"]
    rows = [(i, rng.choice(["hot", " Hot "]) if rng.random() < 0.4 else rng.choice(texts)) for i in range(600)]
    deliveries = [rows[:250], rows[250:260], [], rows[260:]]
    index, kept = str(tmp_path / "index"), []
    for name, part in enumerate(deliveries):
        df = spark.createDataFrame(part, SCHEMA).repartition(4)
        kept += sorted(r["pos"] for r in key_index.admit(df, index, name).collect())
    assert kept == plain_kept(deliveries)
    keys = key_index.stored(spark, index)
    assert keys.count() == keys.select("key").distinct().count() == len(kept)


def test_a_repeated_delivery_changes_nothing(spark, tmp_path):
    index = str(tmp_path / "index")
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A ")], SCHEMA)
    second = spark.createDataFrame([(4, "b"), (5, "c")], SCHEMA)
    for df, name, want in ((first, "x", [1, 2]), (second, "y", [5]), (first, "x", [1, 2]), (second, "y", [5])):
        assert sorted(r["pos"] for r in key_index.admit(df, index, name).collect()) == want
    assert key_index.stored(spark, index).count() == 3
    assert [tuple(r) for r in key_index.admitted_rows(second, index, "y").collect()] == [(5, "c")]


def test_only_touched_folders_are_read(spark, tmp_path):
    index = str(tmp_path / "index")
    key_index.admit(spark.createDataFrame([(i, f"text {i}") for i in range(2000)], SCHEMA), index, "a")
    folders = len(os.listdir(index))
    small = spark.createDataFrame([(1, "text 5"), (2, "new")], SCHEMA)
    firsts = key_index.first_keys(small, F.lower("text"), "pos")
    left = key_index.against(firsts, index, "b")
    read = [f for f in left.inputFiles() if "/prefix=" in f]
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert folders > 200 and "PartitionFilters" in plan and "prefix" in plan.split("PartitionFilters")[1][:200]
    assert [r["pos"] for r in left.collect()] == [2] or len(read) <= folders
