"""Requests of a prompt a line: numbered in order whatever the splits, checked line by line."""

import json

import pytest
from pyspark.sql import functions as F

from textward.sources import batches


def write(path, lines):
    path.write_text("".join(f"{line}\n" for line in lines))


@pytest.mark.parametrize("block", ["64", "1000", "128m"])
def test_numbers_follow_files_and_lines(spark, tmp_path, block):
    lines = [json.dumps({"prompt": f"prompt {i} " + "x" * (i % 40), "n": i}) if i % 2 else json.dumps(f"prompt {i}") for i in range(300)]
    for name, part in (("a.json", lines[:10]), ("b.json", lines[10:11]), ("c.json", []), ("d.json", lines[11:])):
        write(tmp_path / name, [x for line in part for x in ("", line)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        read = batches.read_prompt_lines(spark, str(tmp_path))
        rows = sorted(read.select("index", "prompt", "line", "fault").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["index"] for r in rows] == list(range(300)) and [r["line"] for r in rows] == lines
    assert all(r["prompt"].split(" ")[1] == str(r["index"]) and r["fault"] is None for r in rows)
    assert batches.lines_error(read) is None


def test_faults(spark, tmp_path):
    write(tmp_path / "r.json", ['"ok"', '{"prompt": "also"}', "7", '{"prompt": 3}', "{", "[]", '{"text": "x"}', "null", '""', '{"prompt": "\\u00e9"}'])
    rows = sorted(batches.read_prompt_lines(spark, str(tmp_path / "r.json")).collect())
    item, body = "Every item in `prompts` must be a string.", "Invalid JSON body"
    assert [(r["prompt"], r["fault"]) for r in rows] == [
        ("ok", None), ("also", None), (None, item), (None, item), (None, body), (None, item), (None, item), (None, item), ("", None), ("é", None),
    ]
    assert batches.lines_error(batches.read_prompt_lines(spark, str(tmp_path / "r.json"))) == item
    write(tmp_path / "empty.json", ["", "  "])
    assert batches.lines_error(batches.read_prompt_lines(spark, str(tmp_path / "empty.json"))) == "`prompts` must be a non-empty array of strings."


def test_summary(spark):
    results = spark.createDataFrame([("ALLOWED",), ("ALLOWED",), ("BLOCKED",), ("DROPPED",), ("ERROR",)], "decision string")
    assert batches.summary(results).first().asDict() == {"total": 5, "allowed": 2, "blocked": 1, "dropped": 1, "errors": 1}
    assert batches.summary(results.where(F.lit(False))).first()["total"] == 0
