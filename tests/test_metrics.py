"""Metrics against their definitions, computed row by row."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textward.operators import ensemble as E
from textward.operators import metrics as M
from textward.operators import models, ranks
from textward.plans import evaluation as V

SCHEMA = "tbl string, source string, lang string, label int, pred int, score double, latency_ms double"


def make_rows(n, seed, levels=None):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        score = rng.random() if levels is None else rng.randint(0, levels) / levels
        label = int(rng.random() < 0.2 + 0.5 * score)
        source = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "one_class"])
        label = 0 if source == "one_class" else label
        rows.append(("t", source, rng.choice(["en", "es", None]), label, int(score > 0.5), score, float(rng.randint(1, 50))))
    return rows


def slices(rows):
    out = defaultdict(list)
    for r in rows:
        out[("t", "overall", "all")].append(r)
        out[("t", "source", r[1])].append(r)
        out[("t", "lang", r[2])].append(r)
    return out


def auc_by_pairs(rows):
    p = [r[5] for r in rows if r[3] == 1]
    n = [r[5] for r in rows if r[3] == 0]
    if not p or not n:
        return None, None
    roc = sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))
    ap, before = 0.0, 0.0
    for t in sorted({r[5] for r in rows}, reverse=True):
        tp = sum(x >= t for x in p)
        fp = sum(x >= t for x in n)
        recall = tp / len(p)
        ap += (recall - before) * tp / (tp + fp)
        before = recall
    return roc, ap


def is_p95(value, values):
    """Of the n - 1 steps between the sorted values, 95 in 100 lie below, to the nearest step."""
    below, upto = sum(v < value for v in values), sum(v <= value for v in values)
    place = 0.95 * (len(values) - 1)
    return value in values and below - 0.5 <= place <= upto - 1 + 0.5


@pytest.mark.parametrize("n,levels,per_range", [(700, None, 250_000), (700, None, 10), (600, 10, 5), (500, None, 400)])
def test_report(spark, monkeypatch, n, levels, per_range):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", per_range)
    rows = make_rows(n, n, levels)
    report = {(r["tbl"], r["dimension"], r["value"]): r for r in V.evaluate(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = slices(rows)
    assert set(report) == set(want)
    for key, part in want.items():
        r = report[key]
        tp = sum(x[3] == 1 and x[4] == 1 for x in part)
        fp = sum(x[3] == 0 and x[4] == 1 for x in part)
        tn = sum(x[3] == 0 and x[4] == 0 for x in part)
        fn = len(part) - tp - fp - tn
        assert (r["n"], r["tp"], r["fp"], r["tn"], r["fn"]) == (len(part), tp, fp, tn, fn)
        precision, recall = tp / (tp + fp) if tp + fp else 0.0, tp / (tp + fn) if tp + fn else 0.0
        assert r["precision"] == precision and r["recall"] == recall
        assert r["f1"] == (2 * precision * recall / (precision + recall) if precision + recall else 0.0)
        assert r["accuracy"] == (tp + tn) / len(part)
        roc, ap = auc_by_pairs(part)
        assert r["roc_auc"] == (None if roc is None else pytest.approx(roc, abs=1e-12))
        assert r["pr_auc"] == (None if ap is None else pytest.approx(ap, abs=1e-12))
        assert r["mean_latency_ms"] == pytest.approx(sum(x[6] for x in part) / len(part))
        assert is_p95(r["p95_latency_ms"], [x[6] for x in part])


def test_twelve_latencies(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 13)] + [("b", None)], "k string, v double")
    assert [tuple(r) for r in ranks.value_at_rank(df, ["k"], "v", ranks.p95_rank).collect()] == [("a", 11.0)]


def test_labels_beyond_two_count_as_missed(spark):
    df = spark.createDataFrame([(2, 1), (2, 0), (1, 1), (None, 1)], "label int, pred int")
    r = M.confusion_counts(df).filter("dimension = 'overall'").first()
    assert (r["n"], r["tp"], r["fp"], r["tn"], r["fn"]) == (4, 1, 0, 0, 3)
    names = {(x["dimension"], x["value"]) for x in M.confusion_counts(df).collect()}
    assert names == {("overall", "all"), ("source", "unknown"), ("lang", "unknown")}


def test_no_latency_is_zero(spark):
    df = spark.createDataFrame([("t", "s", "en", 1, 1, 0.5, None)], SCHEMA)
    r = V.evaluate(df).first()
    assert r["mean_latency_ms"] == 0.0 and r["p95_latency_ms"] == 0.0


def test_threshold_sweep(spark):
    rows = make_rows(300, 5, 20)
    got = {(r["tbl"], r["dimension"], r["value"]): (r["flag_from"], r["f1"]) for r in M.threshold_sweep(M.ranked_scores(spark.createDataFrame(rows, SCHEMA))).collect()}
    for key, part in slices(rows).items():
        def f1(t):
            tp = sum(x[3] == 1 and x[5] >= t for x in part)
            fp = sum(x[3] == 0 and x[5] >= t for x in part)
            missed = sum(x[3] == 1 and x[5] < t for x in part)
            return 2 * tp / (2 * tp + fp + missed) if tp else 0.0

        best = max(((f1(t), t) for t in {x[5] for x in part}))
        assert got[key] == (best[1], best[0])


def test_gate_and_bake_off(spark):
    def report(rows):
        return spark.createDataFrame(rows, "tbl string, dimension string, value string, f1 double, recall double")

    sources = ["s1", "s2", "s3"]
    old = report([("m", "overall", "all", 0.6, 0.5), *[("m", "source", s, 0.5, 0.5) for s in sources], ("d", "lang", "es", 0.1, 0.2)])
    good = report([("m", "overall", "all", 0.85, 0.9), ("m", "source", "s1", 0.6, 0.5), ("m", "source", "s2", 0.7, 0.5), ("m", "source", "s3", 0.4, 0.5), ("d", "lang", "es", 0.1, 0.2)])
    poor = report([("m", "overall", "all", 0.84, 0.9), ("m", "source", "s1", 0.9, 0.5), ("d", "lang", "es", 0.1, 0.1)])
    gate = lambda new: V.promotion_gate(new, old, old, "m", ("d", "lang", "es"), sources).first()
    assert gate(good)["promoted"] and gate(good)["sources_gained"] == 2
    p = gate(poor)
    assert (p["f1_ok"], p["spanish_ok"], p["gain_ok"], p["promoted"]) == (False, False, False, False)
    table = V.bake_off({"old": old, "good": good}).filter("dimension = 'overall'").first()
    assert (table["old"], table["good"]) == (0.6, 0.85)


def test_missing_tables_are_skipped(spark, tmp_path, caplog):
    path = str(tmp_path / "there")
    spark.range(3).write.parquet(path)
    tables = V.read_tables(spark, {"a": path, "b": str(tmp_path / "gone")})
    assert list(tables) == ["a"] and "skipping" in caplog.text


def test_compare_over_tables(spark):
    spec = E.ClassifierSpec("kw", options={"keywords": ("bad",)})
    df = spark.createDataFrame([(0, "bad", 1), (1, "fine", 0), (2, "bad", 0)], "pos long, text string, label int")
    report = V.compare(spark, {"x": df, "y": V.first_rows(df, 2)}, {"kw": spec}, "kw")
    overall = {r["tbl"]: r for r in V.rounded_report(report).collect() if r["dimension"] == "overall"}
    assert overall["x"]["accuracy"] == 0.6667 and overall["y"]["accuracy"] == 1.0
    assert V.first_rows(df, 0).count() == V.first_rows(df, None).count() == 3
    with pytest.raises(ValueError):
        V.compare(spark, {"x": df}, {"kw": spec}, "other")


def test_text_model(spark):
    rows = [(f"good day {i}", 0) for i in range(30)] + [(f"evil plan {i}", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "text string, label int")
    out = models.score_toxicity(df, models.train_text_model(df)).collect()
    assert all(r["toxicity"]["passed"] == (r["label"] == 0) for r in out)
    assert all((r["toxicity"]["confidence"] > 0.5) == (r["label"] == 1) for r in out)
    assert out[0]["toxicity"]["detail"].startswith("✅ [CLEAN] SAFE | Confidence: ")
    assert out[-1]["toxicity"]["detail"].startswith("🚩 [ALERT] TOXIC CONTENT | Confidence: ")
    bundle = models.score_bundle(df, models.train_text_model(df), "b", ["safe", "toxic"]).collect()
    assert all(r["result"]["passed"] == (r["label"] == 0) for r in bundle)


def test_sequence_and_truncation(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([0.0, 1.0],)], "logits array<double>")
    r = [x[0] for x in df.select(E.sequence_result("m", F.col("logits"), {0: "SAFE", 1: "INJECTION"}, 0.5)).collect()]
    assert r[0]["passed"] and r[0]["detail"] == "[PASSED] m | P(injection)=50.0%"
    assert not r[1]["passed"] and r[1]["detail"] == "[BLOCKED] m | P(injection)=73.1%"
    assert [x[0] for x in spark.createDataFrame([(127,), (128,)], "n int").select(E.is_truncated(F.col("n"), 128)).collect()] == [False, True]


def test_nested_report(spark, tmp_path):
    import json

    from textward.sources import sinks

    rows = make_rows(60, 8, 5)
    report = V.evaluate(spark.createDataFrame(rows, SCHEMA))
    text = V.nested_report(report, "kw", 10).first()["report"]
    body = json.loads(text)
    overall = M.confusion_counts(spark.createDataFrame(rows, SCHEMA)).filter("dimension = 'overall'").first()
    table = body["tables"]["t"]
    assert body["classifier"] == "kw" and body["limit"] == 10 and table["n"] == 60
    assert table["confusion"] == {k: overall[k] for k in ("tp", "fp", "tn", "fn")}
    assert list(table["by_source"]) == sorted(table["by_source"]) and table["by_source"]["one_class"]["roc_auc"] is None
    sinks.write_report(V.rounded_report(report), str(tmp_path / "r"))
    assert sinks.read_report(spark, str(tmp_path / "r")).count() == report.count()
