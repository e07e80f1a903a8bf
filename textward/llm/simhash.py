"""SimHash near-duplicates: fingerprints compared in blocks of bit planes.

Fingerprints are 64 bits. Those that can be near share a block key; a block's fingerprints are
stored vertically, one word of 64 lanes for each bit, so a single exclusive-or compares a bit of
one fingerprint with a bit of 64 others. Distances are carried in bitwise counters, and pairs of
blocks in which every distance is above the radius are left before their last bits are looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.llm.common import byte_words
from textward.llm.components import components
from textward.session import staged

LANES = 64
# Fingerprints of one block key that are compared together; larger keys are cut into tiles of this size.
TILE = 4096
# Pairs of lane blocks compared in one sweep.
SWEEP = 256
# Planes between two looks at whether a block can be abandoned.
LOOK = 8


def fingerprint(text: str | None, shingle: int) -> tuple[int, int, np.ndarray]:
    """(fingerprint, number of shingles, shingle hashes) of a text; repeats of a shingle count.

    Shingles are ``shingle`` words joined by a space; a text of fewer words is one shingle, one
    without words has none and the fingerprint zero. A bit is set if over half the hashes have it.
    """
    w = byte_words(text)
    if not w:
        return 0, 0, np.empty(0, np.uint64)
    if len(w) <= shingle:
        parts: Iterable[bytes] = (b" ".join(w),)
        n = 1
    else:
        parts = map(b" ".join, zip(*[w[i:] for i in range(shingle)]))
        n = len(w) - shingle + 1
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), np.uint64, n)
    return majority(hashes), n, hashes


def majority(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes have."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for texts of any length
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > n, bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """The documents without their text, with ``fp`` (the fingerprint as a signed long)."""
    kept = [c for c in docs.columns if c not in (text, "fp")]
    base = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(text))
    schema = base.drop(text).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle)[0] for t in batch.column(len(kept)).to_pylist()]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, _longs(found)], names=schema.names)

    return base.mapInArrow(run, schema)


def _longs(unsigned: list[int]) -> pa.Array:
    return pa.array(np.array(unsigned, np.uint64).view(np.int64))


def pigeonhole_keys(fp: Column, radius: int, bits: int = 24) -> Column:
    """Block keys such that fingerprints at most ``radius`` bits apart share one.

    The fingerprint is cut into blocks of which ``radius`` can differ; a key is the number of a
    choice of the others and their bits. As many blocks are chosen as keep about ``bits`` bits.
    """
    blocks = next(n for n in range(radius + 1, 65) if (n - radius) * 64 // n >= bits or n == 64)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64, blocks) of fingerprints (blocks, LANES): bit j of a plane's word is lane j's bit."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, LANES, 8), axis=2, bitorder="little")
    packed = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(64, -1)


def near_pairs(fps: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of fingerprints within the radius, for pairs (a, b) of blocks of LANES each.

    All 64 fingerprints of block a are compared with all lanes of block b. The counters ones, twos,
    fours, ... hold each lane's distance in binary, added to by carry-save; ``over`` keeps lanes
    whose distance left the counters' range. After every few planes, pairs of blocks in which all
    lanes are above the radius are dropped.
    """
    lanes = fps.reshape(-1, LANES)
    planes = planes_of(lanes)
    digits = (radius + 1).bit_length()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, len(a), SWEEP):
        left, right = a[at : at + SWEEP], b[at : at + SWEEP]
        query = lanes[left]
        counter = np.zeros((digits, len(left), LANES), np.uint64)
        over = np.zeros((len(left), LANES), np.uint64)
        for bit in range(64):
            same = np.uint64(0) - (query >> np.uint64(bit) & np.uint64(1))
            carry = planes[bit, right][:, None] ^ same
            for digit in counter:
                digit ^= carry
                carry &= ~digit  # what was one before and is added to
            over |= carry
            if bit % LOOK == LOOK - 1 or bit == 63:
                beyond = over | _above(counter, radius)
                live = (beyond != full).any(axis=1)
                if not live.any():
                    break
                if not live.all():
                    left, right, query = left[live], right[live], query[live]
                    counter, over, beyond = np.ascontiguousarray(counter[:, live]), over[live], beyond[live]
        else:
            near = ~beyond
            pair, i = np.nonzero(near)
            lane_bits = np.unpackbits(near[pair, i].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, j = np.nonzero(lane_bits)
            yield left[pair[row]] * LANES + i[row], right[pair[row]] * LANES + j


def _above(counter: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count, in the counters' digits, is above the radius."""
    above = np.zeros_like(counter[0])
    equal = ~above
    for d in range(len(counter) - 1, -1, -1):
        if radius >> d & 1:
            equal &= counter[d]
        else:
            above |= equal & counter[d]
            equal &= ~counter[d]
    return above


def spanning(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest place that the pairs lead to; pairs come in parts."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            least = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], least)
            np.minimum.at(label, label[j], least)
            label = label[label]
            if (label == before).all():
                break
    while (label != label[label]).any():
        label = label[label]
    return label


def _block_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b), a <= b, of blocks of LANES that have a key in common, of keys in order."""
    first, last = keys[::LANES], keys[LANES - 1 :: LANES]
    n = len(first)
    reach = np.searchsorted(first, last, side="right")  # blocks beyond a that begin with a's last key
    count = np.maximum(reach - np.arange(n), 1)
    a = np.repeat(np.arange(n), count)
    b = a + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
    return a, b


def _compare(batch_keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, smaller place's fp) that span the near fingerprints of a run of whole keys."""
    n = len(fps)
    pad = -n % LANES
    # Padding repeats the last row: it is near itself alone or near what the last row is near.
    fps = np.append(fps, np.repeat(fps[-1:], pad))
    keys = np.append(batch_keys, np.repeat(batch_keys[-1:], pad))
    label = spanning(len(fps), near_pairs(fps, *_block_pairs(keys), radius))
    moved = np.flatnonzero(fps != fps[label])
    return fps[moved], fps[label[moved]]


def links(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b) fingerprints within the radius of each other that share a key, enough of them to connect
    all that do; ``keyed`` has distinct rows (key, fp), fp a long.

    Keys of over TILE fingerprints are cut into tiles by a hash of the fingerprint, and every pair of
    a key's tiles is a task of its own: no key is too large for one task, and none is cut short.
    Keys with one fingerprint are left out.
    """
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(TILE)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    units = (
        keyed.join(sizes, "key").withColumn("tiles", tiles).withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"), "fp"
        )
    )
    ordered = units.repartition(F.col("unit")).sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)

        def found(n: int) -> pa.RecordBatch:
            a, b = _compare(keys[:n], fps[:n].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.append(keys, batch.column(0).to_numpy(zero_copy_only=False))
            fps = np.append(fps, batch.column(1).to_numpy(zero_copy_only=False))
            whole = int(np.searchsorted(keys, keys[-1]))  # the last unit may go on
            if whole >= TILE:
                yield found(whole)
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield found(len(keys))

    return ordered.mapInArrow(run, "a long, b long").distinct()


def _named(of_fp: DataFrame, keyed: DataFrame, radius: int) -> DataFrame:
    """(fp, component) of fingerprints (fp, least): the smallest ``least`` that links lead to."""
    near = components(links(keyed, radius))
    named = near.join(of_fp, near["node"] == of_fp["fp"])
    names = staged(named.groupBy("component").agg(F.min("least").alias("name")), "names")
    linked = near.join(names, "component").select(F.col("node").alias("fp"), "name")
    return staged(of_fp.join(linked, "fp", "left").select("fp", F.coalesce("name", "least").alias("component")), "groups")


def _all_keys(of_fp: DataFrame, radius: int) -> DataFrame:
    return of_fp.select(F.explode(pigeonhole_keys(F.col("fp"), radius)).alias("key"), "fp")


def groups(prints: DataFrame, radius: int, keys: Column | None = None, id: str = "doc_id") -> DataFrame:
    """The rows of ``prints`` (id, fp, ...) with ``component``, the smallest id that links lead to.

    Fingerprints link when at most ``radius`` bits differ. Without ``keys`` every such link is found
    (pigeonhole keys). With ``keys``, an array column, only rows that share one are compared.
    Each fingerprint is compared once, however many rows have it, and the rows of a group are never
    paired. A row with a null id belongs to its fingerprint's group but never names it; a group of
    such rows alone has a null component. Equal rows are alike. An empty table gives an empty one.
    """
    prints = staged(prints.drop("component"), "prints")
    of_fp = staged(prints.groupBy("fp").agg(F.min(id).alias("least")), "least")
    keyed = _all_keys(of_fp, radius) if keys is None else prints.select(F.explode(keys).alias("key"), "fp").distinct()
    return prints.join(_named(of_fp, keyed, radius), "fp")


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of linked fingerprints, with all its columns.

    The smallest id stays; of equal ids the smallest hash of the text, null ids last, and of rows equal
    in both one. Texts without words, null ones too, have the fingerprint zero, which links like any other.

    Fingerprints find each group's head. A group's rows are never brought together: each is compared with
    its head, and only the ids that go are joined to the documents.
    """
    narrow = docs.select(F.col(f"`{id}`").alias("i"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    prints = staged(fingerprints(narrow, shingle), "prints")
    order = F.struct(F.col("i").isNull().alias("last"), F.col("i"), F.col("h"))
    of_fp = staged(prints.groupBy("fp").agg(F.min(order).alias("least")), "least")
    heads = _named(of_fp, _all_keys(of_fp, radius), radius)
    is_head = F.col("i").eqNullSafe(F.col("component.i")) & (F.col("h") == F.col("component.h"))
    gone = staged(prints.join(heads, "fp").where(~is_head).select("i", "h").distinct(), "gone")
    again = staged(prints.groupBy("i", "h").agg(F.count("*").alias("n")).where("n > 1").select("i", "h"), "again")

    rows = docs.select(
        F.col(f"`{id}`").alias("_i"), F.xxhash64(F.col(f"`{text}`")).alias("_h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    )
    same = F.col("_i").eqNullSafe(F.col("i")) & (F.col("_h") == F.col("h"))
    left = rows.join(gone, same, "left_anti")
    once = left.join(again, same, "left_anti")
    twice = left.join(again, same, "left_semi").dropDuplicates(["_i", "_h"])
    return once.unionByName(twice).select("row.*")
