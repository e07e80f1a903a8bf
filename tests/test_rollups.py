"""Daily partials merge to what the whole log gives, late days made again alone."""

import datetime as dt
import os
import random
from collections import defaultdict

from textward.operators import rollups

SCHEMA = "id long, ts timestamp, kind string, cents long, user long"
BY = {"by": "kind", "value": "cents", "distinct": "user"}


def log_rows(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(12), seconds=rng.randrange(86_400))
        kind = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        rows.append((i, at if rng.random() < 0.98 else None, kind, rng.randrange(10**6) if kind != "b" else None, rng.randrange(400)))
    return rows


def check(rows, got):
    want = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            want[r[2]].append(r)
    assert {r["kind"] for r in got} == set(want)
    for r in got:
        mine = want[r["kind"]]
        values = sorted(x[3] for x in mine if x[3] is not None)
        assert (r["n"], r["n_values"], r["days"]) == (len(mine), len(values), len({x[1].date() for x in mine}))
        if not values:
            assert r["mean"] is None and r["quantile"] is None
            continue
        assert abs(r["mean"] - sum(values) / len(values)) < 1e-6
        rank = sum(v <= r["quantile"] for v in values) / len(values)
        assert abs(rank - 0.95) < 0.02
        assert abs(r["members"] - len({x[4] for x in mine})) <= 0.03 * 400


def test_days_merge_to_the_whole_log(spark, tmp_path):
    rows, path = log_rows(6000), str(tmp_path / "rollups")
    rollups.store(rollups.partials(spark.createDataFrame(rows, SCHEMA).repartition(7), **BY), path)
    check(rows, rollups.merged(rollups.read(spark, path), "kind").collect())
    span = rollups.read(spark, path, "2024-01-03", "2024-01-05")
    inside = [r for r in rows if r[1] is not None and dt.date(2024, 1, 3) <= r[1].date() <= dt.date(2024, 1, 5)]
    check(inside, rollups.merged(span, "kind").collect())
    assert "PartitionFilters: [isnotnull(day" in span._jdf.queryExecution().executedPlan().toString()


def test_late_entries_change_their_days_alone(spark, tmp_path):
    rows, path = log_rows(3000, 2), str(tmp_path / "rollups")
    late = [r for r in rows if r[0] % 9 == 0 and r[1] is not None and r[1].date() in (dt.date(2024, 1, 4), dt.date(2024, 1, 12))]
    early = [r for r in rows if r not in late]
    rollups.store(rollups.partials(spark.createDataFrame(early, SCHEMA), **BY), path)
    check(early, rollups.merged(rollups.read(spark, path), "kind").collect())
    files = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("day=")}
    before = files()
    log = spark.createDataFrame(rows, SCHEMA)
    assert rollups.refresh(log, spark.createDataFrame(late, SCHEMA), path, **BY) == ["2024-01-04", "2024-01-12"]
    assert {d for d, names in files().items() if names != before[d]} == {"day=2024-01-04", "day=2024-01-12"}
    check(rows, rollups.merged(rollups.read(spark, path), "kind").collect())
    assert rollups.refresh(log, log.limit(0), path, **BY) == []


def test_an_empty_log(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    assert rollups.merged(rollups.partials(empty, **BY), "kind").count() == 0
