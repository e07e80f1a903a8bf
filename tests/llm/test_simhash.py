import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textward.llm import simhash
from textward.llm.components import components
from textward.llm.queries import QUERIES

from .conftest import SF


def plain_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(names, linked):
    """Smallest name in each one's component, by flooding."""
    found = {}
    for a in sorted(names):
        stack = [a] if a not in found else []
        while stack:
            x = stack.pop()
            if x not in found:
                found[x] = a
                stack += [y for y in names if y not in found and linked(x, y)]
    return found


@pytest.mark.parametrize("radius", [0, 1, 2, 5, 18])
def test_planes_find_what_popcount_finds(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**64, 640, dtype=np.uint64)
    for i in range(320):
        flips = rng.choice(64, rng.integers(0, 22), replace=False)
        fps[320 + i] = fps[i] ^ np.uint64(sum(1 << int(b) for b in flips))
    a, b = np.triu_indices(10)
    got = {(min(x, y), max(x, y)) for i, j in simhash.near_pairs(fps, a, b, radius) for x, y in zip(i.tolist(), j.tolist()) if x != y}
    distance = np.bitwise_count(fps[:, None] ^ fps)
    assert got == {(x, y) for x, y in np.argwhere(distance <= radius).tolist() if x < y}


def test_blocks_of_common_keys_meet():
    keys = np.sort(np.random.default_rng(1).integers(0, 40, 640))
    pairs = set(zip(*(x.tolist() for x in simhash._block_pairs(keys))))
    assert pairs >= {(x // 64, y // 64) for x in range(640) for y in range(x, 640) if keys[x] == keys[y]}


def test_near_fingerprints_share_a_key(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(200):
        fp = int(rng.integers(0, 2**63))
        other = fp ^ sum(1 << int(b) for b in rng.choice(63, 2, replace=False))
        rows.append((fp, other))
    df = spark.createDataFrame(rows, "a long, b long")
    keys = lambda c: simhash.pigeonhole_keys(F.col(c), 2)
    assert df.where(F.arrays_overlap(keys("a"), keys("b"))).count() == 200


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 60)] + [(3, 3), (5, 4), (4, 5), (None, 1)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)} | {4: 4, 5: 4}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    rows = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    fps = {i: plain_fingerprint(t, 3) for i, t in rows.items()}
    group = plain_groups(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = QUERIES["op1_simhash"](spark, SF).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fps[i]:016x}", group[i]) for i in fps}


def test_large_keys_are_tiled(spark, monkeypatch):
    """With tiles of a few fingerprints, the links of one block stay whole."""
    monkeypatch.setattr(simhash, "TILE", 8)
    fps = [1 << 40 | i for i in range(64)]
    df = spark.createDataFrame([(f, f) for f in fps], "doc_id long, fp long")
    got = {r.component for r in simhash.groups(df, 1, keys=F.array(F.lit(1).cast("long"))).collect()}
    assert got == {fps[0]}


def test_odd_rows(spark, odd, none):
    got = simhash.groups(simhash.fingerprints(odd.drop("size"), 3), 2).select("doc_id", "component").collect()
    assert len(got) == 11
    by = {r.doc_id: r.component for r in got}
    assert by[1] == by[2] == 1 and by[3] == by[4] == by[5] == 3 and by[None] is None and by[6] == 6
    assert simhash.groups(simhash.fingerprints(none, 3), 2).count() == 0


def test_one_document_of_each_group_stays(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    fps = {i: plain_fingerprint(t, 3) for i, t in docs.collect()}
    group = plain_groups(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert sorted(r.doc_id for r in simhash.deduplicate(docs).collect()) == sorted(set(group.values()))
    renamed = odd.withColumnRenamed("lang", "_i").withColumnRenamed("size", "h").withColumnRenamed("source", "row")
    kept = simhash.deduplicate(renamed)
    assert kept.columns == renamed.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 3, 6, 7, 8]
    assert simhash.deduplicate(none).count() == 0


def test_rows_without_an_id_stay_once_a_group(spark):
    rows = [(None, "one two three four"), (None, "one two three four"), (None, "five six seven"), (3, "five six seven"), (None, "eight")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "eight"), (0, "one two three four"), (3, "five six seven")]


def test_thousands_of_copies(spark):
    rows = [(i, "a text that very many documents have in common") for i in range(5000)] + [(5000, "another one of its own")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5000]
