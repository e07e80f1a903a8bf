"""Tables and reports the jobs leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# File names of the two known held-out sets.
HELD_OUT_NAMES = {
    "davidtkeane_prompt_injection": "eval_davidtkeane",
    "jailbreakbench_behaviors": "eval_jailbreakbench",
}


def write_table(df: DataFrame, path: str) -> bool:
    """Zstandard Parquet; an empty DataFrame is not written and False comes back."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return True


def write_splits(df: DataFrame, path: str) -> None:
    """train, val and test in one pass, one folder per split (``split=train`` and so on)."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("split").parquet(path)


def held_out_name(source: str) -> str:
    return HELD_OUT_NAMES.get(source, f"eval_{source}")


def write_held_out(df: DataFrame, path: str, source: str) -> bool:
    """One held-out set as it came: not deduplicated, balanced or split."""
    return write_table(df, f"{path.rstrip('/')}/{held_out_name(source)}.parquet")


def as_json_report(df: DataFrame, column: str = "report") -> DataFrame:
    """The rows as one JSON text column, keys in column order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias(column))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines in a folder."""
    as_json_report(df).write.mode("overwrite").text(path)


def read_report(spark, path: str) -> DataFrame:
    return spark.read.json(path)
