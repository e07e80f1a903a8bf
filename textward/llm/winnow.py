"""Benchmark decontamination by winnowing: windows of benchmark words found again in documents.

A window is so many consecutive words of an item; an item of fewer words is one window as a whole.
Every k-gram of words has a hash, and of each run of k-grams that fill a window the smallest (the
last of equal ones) is kept. A window that stands in an item and in a document keeps the same
k-gram in both, so a join of the kept hashes misses none. Hits are then extended to the whole
windows around them, which are compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.llm.buffers import runs
from textward.llm.common import ascii_lower
from textward.session import staged

# Words of a text in lower case: runs of digits, a to z and whatever is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bits of the filter for benchmark hashes at most, 8 MB; with more hashes than that it only lets more through.
FILTER_BITS = 1 << 26

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[65:91] = _IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
_STEP = 0xD1342543DE82EF95


def gram(window: int) -> int:
    """Words of a k-gram for windows of so many words: about half of them, so that the grams in a window are
    as many, less one at most."""
    return (window + 2) // 2


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, made longer when a longer run comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors))
        return self.up[:n], self.down[:n]


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, first) of the words in the bytes of texts; ``first`` has the first word of each text,
    and the number of all."""
    inside = _IS_WORD[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True  # a word does not go on into the next text
    before = np.append(False, inside)
    after = np.append(inside, False)
    begins = np.flatnonzero(after & (~before | fresh))
    ends = np.flatnonzero(before & (~after | fresh))
    return begins, ends, np.searchsorted(begins, offsets)


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each word: a polynomial in its bytes, from differences of one cumulative sum."""
    up, down = powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return _mixed((total[ends] - total[begins]) * down[begins])


def kept(word: np.ndarray, first: np.ndarray, window: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the k-grams that windows within one text keep; of all texts, or of those marked."""
    k, n = gram(window), len(word) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.zeros(len(word) - k + 1, np.uint64)
    factor = 1
    for j in range(k):
        grams += word[j : j + len(grams)] * np.uint64(factor)
        factor = factor * _STEP % (1 << 64)
    grams = _mixed(grams ^ np.uint64(window * _BASE % (1 << 64)))
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, window - k + 1):
        later = grams[j : j + n]
        take = later <= least
        least[take] = later[take]
        at[take] = np.flatnonzero(take) + j
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    whole = first[row + 1] - np.arange(n) >= window
    if rows is not None:
        whole &= rows[row]
    at, least = at[whole], least[whole]
    new = np.diff(at, prepend=-1) != 0  # windows that follow each other mostly keep the same one
    return at[new], least[new]


def item_fingerprints(items: DataFrame, window: int) -> DataFrame:
    """(hash) of the k-grams kept in items (text), distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for _, _, data, offsets in runs(batch.column(0)):
                begins, ends, first = tokens(data, offsets)
                word = hashes(data, begins, ends, powers)
                count = np.diff(first)
                for size in range(1, window + 1):
                    mine = count >= window if size == window else count == size
                    if mine.any():
                        yield pa.RecordBatch.from_arrays([pa.array(kept(word, first, size, mine)[1].view(np.int64))], names=["hash"])

    return items.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "hash long").distinct()


def hash_filter(fingerprints: DataFrame) -> np.ndarray:
    """A bit set for each of the hashes, as 64-bit words: 16 bits a hash, but FILTER_BITS at most."""
    bits = 1 << 10
    while bits < min(16 * fingerprints.count(), FILTER_BITS):
        bits *= 2
    place = F.col("hash").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    found = fingerprints.groupBy((F.shiftright(place, 6)).alias("at")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


HIT = T.StructType().add("window", "integer").add("hash", "long").add("at", "integer").add("context", "string")


def fingerprint_hits(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """(d, h, n_words, hits) of documents (d, h, text): kept k-grams whose hash the filter lets through, with
    ``context``, the words of all windows around the k-gram, which begins at the document's word ``at``."""
    schema = docs.select("d", "h").schema.add("n_words", "long").add("hits", T.ArrayType(HIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        mask = np.uint64(len(bits) * 64 - 1)
        for batch in batches:
            for low, beyond, data, offsets in runs(batch.column(2)):
                begins, ends, first = tokens(data, offsets)
                word = hashes(data, begins, ends, powers)
                parts = []
                for size in sizes:
                    at, value = kept(word, first, size)
                    place = value & mask
                    let = bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1
                    parts.append((np.full(int(let.sum()), size, np.int32), at[let], value[let]))
                size_, at, value = (np.concatenate(x) for x in zip(*parts))
                row = np.searchsorted(first, at, side="right") - 1
                order = np.argsort(row, kind="stable")
                size_, at, value, row = size_[order], at[order], value[order], row[order]
                around = size_ - (size_ + 2) // 2
                begin = np.maximum(at - around, first[row])
                end = np.minimum(at + size_, first[row + 1])
                lower = _LOWER[data].tobytes()
                b, e = begins.tolist(), ends.tolist()
                context = [b" ".join(lower[b[i] : e[i]] for i in range(x, y)) for x, y in zip(begin.tolist(), end.tolist())]
                hits = pa.StructArray.from_arrays(
                    [
                        pa.array(size_, pa.int32()), pa.array(value.view(np.int64)), pa.array((begin - first[row]).astype(np.int32)),
                        pa.array(context, pa.binary()).cast(pa.string()),
                    ],
                    names=HIT.names,
                )
                counts = np.searchsorted(row, np.arange(beyond - low + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, beyond - low), batch.column(1).slice(low, beyond - low),
                        pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), hits),
                    ],
                    names=schema.names,
                )

    return docs.select("d", "h", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def _windows(words: Column, size: Column) -> Column:
    """(no, window) of each run of ``size`` words, joined by a space."""
    return F.when((size > 0) & (F.size(words) >= size), F.transform(
        F.sequence(F.lit(0), F.size(words) - size),
        lambda i: F.struct(i.alias("no"), F.array_join(F.slice(words, i + 1, size), " ").alias("window")),
    ))


def find(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, text_hash, n_words, n_hit, spans, items) of every document: which of its words stand in a window of
    the benchmark.

    ``spans`` are the ranges of such words (begin, end), whole texts counted from 0, that do not touch;
    ``n_hit`` is their length; ``items`` are the distinct ids, as strings in order, of the items with a window
    in the document. All are exact: every window found is compared by its words, and none is missed.

    Documents: a null text has no words; a row comes out for each row, alike for rows equal in id and
    text. Items: one without words has no window; repeated ids are one item with the windows of each; a null
    id is an empty string. Either table may be empty.

    How. Kept hashes of the items make a filter of 8 MB at most, through which the documents' kept hashes
    pass where they are made; what is left is joined with the hashes, extended, and joined with the windows.
    Items equal in words are one class until the end, when the classes found in a document get their ids.
    Nothing that is broadcast by hand grows with a table; hot hashes and windows are plain equi-joins on the
    documents' side, which skew handling can split.
    """
    narrow = docs.select(F.col(f"`{id}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    read = benchmark.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.array_join(words(F.col(f"`{item_text}`")), " ").alias("text")
    ).where("text <> ''")
    items = staged(read.withColumn("class", F.unhex(F.sha2(F.col("text").cast("binary"), 256))), "items")
    texts = items.groupBy("class").agg(F.first("text").alias("text"))
    part = F.split("text", " ")
    size = F.least(F.size(part), F.lit(window))
    windows = staged(
        texts.select("class", size.alias("size"), F.explode(_windows(part, size)).alias("w")).select("class", "size", "w.window").distinct(),
        "windows",
    )
    prints = staged(item_fingerprints(items.select("text"), window), "fingerprints")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect()) or [window]

    hits = staged(fingerprint_hits(narrow, sizes, hash_filter(prints)), "hits")
    passed = hits.where(F.size("hits") > 0).select("d", "h", F.explode("hits").alias("hit")).select("d", "h", "hit.*")
    met = passed.join(prints, "hash", "left_semi").withColumnRenamed("window", "size")
    tried = met.select("d", "h", "size", "at", F.explode(_windows(F.split("context", " "), F.col("size"))).alias("w")).select(
        "d", "h", "size", (F.col("at") + F.col("w.no")).alias("begin"), "w.window"
    )
    found = staged(tried.join(windows.select("class", "window"), "window").select("d", "h", "begin", "size", "class"), "found")
    marked = found.groupBy("d", "h").agg(F.sort_array(F.collect_set(F.struct("begin", "size"))).alias("at"))
    marked = marked.select("d", "h", _merged(F.col("at")).alias("spans"))
    listed = found.select("d", "h", "class").distinct().join(items.select("class", "item"), "class")
    listed = listed.groupBy("d", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))

    out = hits.select("d", "h", "n_words")
    for more in (marked, listed):
        more = more.withColumnsRenamed({"d": "_d", "h": "_h"})
        out = out.join(more, F.col("d").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left").drop("_d", "_h")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return out.select(
        F.col("d").alias(id), F.col("h").alias("text_hash"), "n_words", F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def _merged(at: Column) -> Column:
    """Ranges (begin, end) that cover windows (begin, size) in order and do not touch."""
    ranges = F.transform(at, lambda w: F.struct(w["begin"].alias("begin"), (w["begin"] + w["size"]).alias("end")))
    # A range goes on if the next begins no later than the furthest end so far, which rises with the begin.
    state = F.aggregate(
        ranges,
        F.struct(F.array().cast("array<struct<begin:int,end:int>>").alias("done"), F.lit(-1).alias("begin"), F.lit(-1).alias("end")),
        lambda s, r: F.when(r["begin"] <= s["end"], F.struct(
            s["done"].alias("done"), s["begin"].alias("begin"), F.greatest(s["end"], r["end"]).alias("end")
        )).otherwise(F.struct(
            F.when(s["end"] < 0, s["done"]).otherwise(F.array_append(s["done"], F.struct(s["begin"].alias("begin"), s["end"].alias("end")))).alias("done"),
            r["begin"].alias("begin"), r["end"].alias("end"),
        )),
        lambda s: F.array_append(s["done"], F.struct(s["begin"].alias("begin"), s["end"].alias("end"))),
    )
    return state


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents in which no window of the benchmark stands, with all their columns; rows and columns as
    ``find`` takes them."""
    hit = find(docs, benchmark, id=id, text=text, **how).where("n_hit > 0").select(F.col(f"`{id}`").alias("d"), "text_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    mine = F.col("row").getField(id).eqNullSafe(F.col("d")) & (F.xxhash64(F.col("row").getField(text)) == F.col("text_hash"))
    return rows.join(hit.distinct(), mine, "left_anti").select("row.*")
