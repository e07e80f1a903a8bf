import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textward.llm import hmm
from textward.llm.queries import QUERIES

from .conftest import SF


def some_model(seed=0, k=3, classes=5):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(rng.random(k), 0), norm(rng.random((k, k)), 1), norm(rng.random((classes, k)), 0))


def plain_likelihood(m, sequence):
    """The sum over all paths of states."""
    total = 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(sequence)):
        p = m.start[path[0]]
        for i, (state, symbol) in enumerate(zip(path, sequence)):
            p *= (m.moves[path[i - 1], state] if i else 1) * m.emits[symbol, state]
        total += p
    return total


def test_forward_is_the_sum_over_paths():
    m = some_model()
    sequences = [np.array(s, np.uint16) for s in ([0], [1, 4, 2], [3, 3, 3, 0, 1, 2], [2, 0])]
    got = hmm.log10_likelihoods(m, sequences)
    assert got == pytest.approx([math.log10(plain_likelihood(m, s)) for s in sequences])


def test_expected_counts_against_all_paths():
    m = some_model(1)
    sequences = [np.array([3, 1, 1, 4, 0], np.uint16), np.array([2, 2], np.uint16)]
    start, moves, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in sequences:
        whole = plain_likelihood(m, s)
        for path in itertools.product(range(3), repeat=len(s)):
            p = m.start[path[0]]
            for i, state in enumerate(path):
                p *= (m.moves[path[i - 1], state] if i else 1) * m.emits[s[i], state]
            start[path[0]] += p / whole
            for i, state in enumerate(path):
                emits[s[i], state] += p / whole
                if i:
                    moves[path[i - 1], state] += p / whole
    got = hmm.expected(m, sequences)
    for want, part in zip((start, moves, emits), got):
        assert np.allclose(part, want)
    assert got[3] == pytest.approx(sum(math.log(plain_likelihood(m, s)) for s in sequences))


def test_training_rounds_never_lose_likelihood(spark):
    rng = np.random.default_rng(2)
    sequences = [np.array(rng.integers(0, 4, 30) + (4 if i % 2 else 0), np.uint16) for i in range(40)]
    rows = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sequences], "classes binary").repartition(3)
    counts = np.bincount(np.concatenate(sequences), minlength=8).astype(float)
    likelihood = []
    for rounds in (0, 1, 3, 8):
        m = hmm.train(rows, hmm.Settings(states=2, classes=8, rounds=rounds, smoothing=1e-9), counts)
        likelihood.append(hmm.log10_likelihoods(m, sequences).sum())
    assert likelihood == sorted(likelihood)


def test_chances_of_words_sum_to_one():
    """A class's words and the mass for words not seen."""
    c = np.array([5.0, 1.0, 2.0, 0.0])
    of_class = np.array([[1.0, 1.0], [8.0, 3.0]])
    import pyarrow as pa

    left = pa.table({"doc_id": [0, 1, 2, 3], "held_out": [False] * 4, "block": [0] * 4, "ids": [hmm._planes(np.array([i], np.uint32)) for i in range(4)], "chain": [0.0] * 4})
    right = pa.table({"of_block": [0] * 4, "at": list(range(4)), "c": c, "class": [1] * 4})
    got = hmm._add_words(left, right, of_class, 0.5, 10.0, 1, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
    assert sum(10 ** s for s in got.column("score").to_pylist()) == pytest.approx(1.0)


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    held = F.col("doc_id") % 5 == 0
    rows = lambda: {r.doc_id: r for r in hmm.score(docs, held, hmm.Settings(rounds=1, classes=64)).collect()}
    large = rows()
    counts = Counter()
    for doc_id, text in docs.collect():
        if doc_id % 5:
            counts.update(text.encode().lower().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    for doc_id, text in docs.collect():
        tokens = text.encode().lower().split() + [b""]
        r = large[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens))
    monkeypatch.setattr(hmm, "BLOCK_CHARS", 20_000)
    small = rows()
    assert {i: (r.n_tokens, r.n_known) for i, r in small.items()} == {i: (r.n_tokens, r.n_known) for i, r in large.items()}
    assert [small[i].score for i in sorted(small)] == pytest.approx([large[i].score for i in sorted(large)])


def test_query_beats_single_words_on_texts_held_out(spark):
    rows = QUERIES["op3_hmm"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert {zlib.crc32(str(r.doc_id).encode()) % 7 for r in rows} == {2}
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score - r.base_score for r in rows) / tokens > 0.2


def test_odd_rows(spark, odd, none):
    settings = hmm.Settings(rounds=1, classes=32, states=2)
    got = hmm.score(odd, F.col("doc_id") == 6, settings).collect()
    assert len(got) == 11 and all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    nothing = hmm.score(odd, F.lit(True), settings).collect()
    assert {r.train_tokens for r in nothing} == {0} and all(r.n_known == 0 and math.isfinite(r.score) for r in nothing)
    assert hmm.score(none, F.lit(False), settings).count() == 0
