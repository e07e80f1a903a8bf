"""Runs every query and its DuckDB twin at a scale factor and compares the rows."""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from textward.session import build_session  # noqa: E402
from verification.oracle import ORACLE  # noqa: E402
from verification.queries import QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if hasattr(v, "isoformat"):
            return v.replace(tzinfo=None).isoformat()
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, connection, sf_dir: str, name: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE:
        return f"{len(got)} rows, no twin"
    cursor = connection.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    want = canonical(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"DIFFERS {len(got)} vs {len(want)}\n   spark {str(extra)[:700]}\n   duck  {str(missing)[:700]}"
    return f"ok {len(got)}"


def main() -> int:
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(QUERIES)
    work = tempfile.mkdtemp(prefix="textward-check-")
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.textward.read.partitions": "8",
            "spark.checkpoint.dir": work,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    bad = 0
    for name in names:
        began = time.time()
        try:
            verdict = compare(spark, connection, sf_dir, name)
        except Exception as exc:
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        bad += not verdict.startswith(("ok",)) and "no twin" not in verdict
        print(f"{name:24s} {time.time() - began:6.1f}s {verdict}", flush=True)
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
