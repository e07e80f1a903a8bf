"""Reading small tables without leaving the cores idle."""

from __future__ import annotations

from pyspark.sql import DataFrame

PARTITIONS = "spark.textward.read.partitions"


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """The table hashed by a unique key over so many tasks; without a number, as its files are.

    A small table is often one row group, which is one task however many cores there are; whoever
    runs such tables asks for more, by argument or by the setting ``spark.textward.read.partitions``.
    """
    number = partitions or int(df.sparkSession.conf.get(PARTITIONS, None) or 0)
    return df.repartition(number, key) if number else df
