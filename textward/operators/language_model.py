"""A detector of languages learned from labelled texts: counts of character runs, joined and summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StringType, StructField, StructType

from textward.functions.planning import broadcast_if_small
from textward.session import staged

GRAM = 3
# Logarithms are whole millionths, so that sums do not depend on their order.
SCALE = 1_000_000


def plain(text: Column) -> Column:
    """A text in lower case, white space made one space, with a space at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), F.lit(" "))


def n_grams(text: Column, n: int = GRAM) -> Column:
    """How many runs of ``n`` characters a text has; none for null."""
    return F.coalesce(F.greatest(F.length(plain(text)) - (n - 1), F.lit(0)), F.lit(0)).cast("bigint")


# Texts and characters whose runs are counted at once.
RUN_TEXTS, RUN_CHARS = 256, 4_000_000


def _counted(keys: np.ndarray, texts: list[str], n: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Of texts with keys from 0 on: a key, a place in a list of runs, and a count of each row; and that list."""
    lengths = np.array([len(t) for t in texts])
    kinds, codes = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    if int(len(kinds)) ** n * (int(keys.max(initial=0)) + 1) >= 1 << 63:
        raise ValueError("too many kinds of characters at once")
    base = len(kinds)
    run = codes[: len(codes) - n + 1].astype(np.int64)
    for k in range(1, n):
        run = run * base + codes[k : len(codes) - n + 1 + k]
    # Runs that begin in a text and end in it.
    ends = np.cumsum(lengths)
    left = np.repeat(ends, lengths)[: len(run)] - np.arange(len(run))
    both = (np.repeat(keys, lengths)[: len(run)] * base**n + run)[left >= n]
    both, counts = np.unique(both, return_counts=True)
    runs, place = np.unique(both % base**n, return_inverse=True)
    chars = np.stack([kinds[runs // base**k % base] for k in range(n - 1, -1, -1)], 1).astype(np.uint32)
    names = [row.tobytes().decode("utf-32-le", "surrogatepass") for row in chars]
    return both // base**n, names, place, counts


def _count_batches(batches: Iterator[pa.RecordBatch], n: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(1)))
        sizes = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(batch):
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, min(start + RUN_TEXTS, int(np.searchsorted(sizes, before + RUN_CHARS, "right"))))
            part = batch.slice(start, stop - start)
            start = stop
            each = part.column(0).dictionary_encode(null_encoding="encode")
            found, names, place, counts = _counted(each.indices.to_numpy().astype(np.int64), part.column(1).to_pylist(), n)
            if len(found):
                key = each.dictionary.cast(kind).take(pa.array(found))
                gram = pa.array(names, pa.string()).take(pa.array(place))
                yield pa.RecordBatch.from_arrays([key, gram, pa.array(counts, pa.int64())], ["key", "gram", "n"])


def gram_counts(docs: DataFrame, key: Column, text: str = "text", n: int = GRAM) -> DataFrame:
    """(key, gram, n): how often texts of each key have each run of ``n`` characters, in rows whose counts add up.

    Counted where the texts are, a few hundred at a time, before any shuffle: a run is a number made of its
    characters' places among those that occur.
    """
    rows = docs.select(key.alias("key"), plain(F.col(text)).alias("plain"))
    schema = StructType([StructField("key", rows.schema["key"].dataType), StructField("gram", StringType()), StructField("n", LongType())])
    kind = to_arrow_type(schema["key"].dataType)
    return rows.mapInArrow(lambda batches: _count_batches(batches, n, kind), schema)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(weights, totals) learned from labelled documents; those without a language are left out.

    ``weights`` (gram, lang, weight) are the logarithms of a run's count in a language and one; ``totals``
    (lang, total) those of all runs of the language and one for each run there is. The languages are what the
    table has. Runs in the hands of few tasks are counted before they are shuffled.
    """
    runs = gram_counts(docs.where(F.col(lang).isNotNull()), F.col(lang), text).withColumnRenamed("key", "lang")
    counts = staged(runs.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "grams")
    kinds = counts.agg(F.count_distinct("gram").alias("kinds"))
    weights = counts.select("gram", "lang", _log(F.col("n") + 1).alias("weight"), "n")
    per_lang = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    totals = per_lang.select("lang", _log(F.col("n") + F.lit(kinds.scalar())).alias("total"))
    return weights.drop("n"), totals


def _log(x: Column) -> Column:
    return F.round(F.ln(x) * SCALE).cast("bigint")


def detect(docs: DataFrame, weights: DataFrame, totals: DataFrame, id: str, text: str = "text", gate: float = 0.02) -> DataFrame:
    """(id, lang, margin) of every document: the language in which its runs are likeliest, null if the second is
    less than ``gate`` behind per run, or if there is no run; equal ones go by name.

    A run that a language never had counts as one seen zero times, so a document meets only the weights of runs
    it shares; the rest is its number of runs times the language's total. ``margin`` is the mean logarithm by
    which the best is ahead.
    """
    sizes = docs.select(F.col(id).alias("id"), n_grams(F.col(text)).alias("runs"))
    # A row for each document and language: languages are few, and travel as one array in each row.
    langs = totals.agg(F.sort_array(F.collect_list(F.struct("lang", "total"))).alias("langs")).first()["langs"] or []
    table = F.array(*[F.struct(F.lit(r["lang"]).alias("lang"), F.lit(r["total"]).cast("bigint").alias("total")) for r in langs])
    if not langs:
        return sizes.select(F.col("id").alias(id), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("margin"))
    # A row for each run, with its weight in every language, so that a document's runs are looked up once.
    by_lang = [F.sum(F.when(F.col("lang") == r["lang"], F.col("weight"))).alias(f"w{i}") for i, r in enumerate(langs)]
    wide = broadcast_if_small(staged(weights.groupBy("gram").agg(*by_lang), "weights"))
    sums = [F.struct(F.lit(r["lang"]).alias("lang"), F.sum(F.col("n") * F.col(f"w{i}")).alias("hit")) for i, r in enumerate(langs)]
    found = gram_counts(docs, F.col(id), text).join(wide, "gram").groupBy("key").agg(F.array(*sums).alias("hits"))
    hits = found.select(F.col("key").alias("id"), F.inline("hits")).where("hit is not null")
    asked = sizes.select("id", "runs", F.explode(table).alias("l")).select("id", "runs", "l.*")
    scored = asked.join(hits, ["id", "lang"], "left").select(
        "id", "runs", "lang", (F.coalesce("hit", F.lit(0)) - F.col("runs") * F.col("total")).alias("score")
    )
    ranked = scored.groupBy("id").agg(
        F.max("runs").alias("runs"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("cost"), "lang"))).alias("best")
    )
    best, second = F.get("best", F.lit(0)), F.get("best", F.lit(1))
    ahead = F.when(F.col("runs") > 0, (second["cost"] - best["cost"]) / (F.col("runs") * F.lit(float(SCALE))))
    sure = (F.col("runs") > 0) & (second.isNull() | (second["cost"] - best["cost"] >= F.lit(round(gate * SCALE)) * F.col("runs")))
    return ranked.select(F.col("id").alias(id), F.when(sure, best["lang"]).alias("lang"), ahead.alias("margin"))
