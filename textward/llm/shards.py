"""Sharding by a permutation-filled lookup table, so that few documents move when shards change."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[str]:
    """The shard of each slot. Shards take turns; at its turn a shard claims the first free slot in its
    own order of preference, which steps through the prime-sized table from an offset, both from
    hashes of its name. The table is configuration: its size is a parameter, whatever the data.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, and at least one")
    if size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime not below the number of shards")
    steps = []
    for name in sorted(shards):
        digest = hashlib.sha256(name.encode()).digest()
        offset, skip = (int.from_bytes(digest[i : i + 8], "big") for i in (0, 8))
        steps.append([name, offset % size, skip % (size - 1) + 1])
    owner: list[str | None] = [None] * size
    free = size
    while free:
        for turn in steps:
            if not free:
                break
            name, slot, skip = turn
            while owner[slot] is not None:
                slot = (slot + skip) % size
            owner[slot] = name
            turn[1] = (slot + skip) % size
            free -= 1
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """A key's slot: 60 bits of its MD5, modulo the table's size; a null key is an empty one."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return (F.conv(digits, 16, 10).cast("bigint") % size).cast("int")


def lookup_table(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard) with one row per slot."""
    return spark.createDataFrame(list(enumerate(fill(shards, size))), "slot int, shard string")


def place(docs: DataFrame, shards: list[str], key: Column | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """The documents with their ``slot`` and ``shard`` in place of columns so called.

    A document goes where its key (doc_id if none is given) says, alone and the same on every run; so
    no shuffle and no order is needed, and equal keys, null ones too, share a shard. The lookup
    table has ``size`` rows, which bounds the broadcast. An empty table gives an empty table.
    """
    key = F.col("doc_id") if key is None else key
    kept = docs.withColumn("_slot", slot_of(key, size)).drop("slot", "shard").withColumnRenamed("_slot", "slot")
    return kept.join(F.broadcast(lookup_table(docs.sparkSession, shards, size)), "slot").select(*kept.columns, "shard")
