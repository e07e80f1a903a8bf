import random
import re

import numpy as np
import pytest

from textward.llm import queries, winnow

from .conftest import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(text, items, window=10):
    """(words, words hit, items) by looking at every place of the text."""
    w = plain_words(text)
    hit, found = set(), set()
    for item, item_text in items:
        v = plain_words(item_text)
        size = min(window, len(v))
        wanted = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1) if v else ():
            if tuple(w[i : i + size]) in wanted:
                hit.update(range(i, i + size))
                found.add("" if item is None else str(item))
    return len(w), hit, sorted(found)


def check(docs, items, rows, window=10):
    assert len(rows) == len(docs)
    want = {(d, t): plain(t, items, window) for d, t in set(docs)}
    by = {}
    for d, t in docs:
        by.setdefault(d, []).append(want[d, t])
    for r in rows:
        inside = {i for s in r.spans for i in range(s.begin, s.end)}
        assert (r.n_words, inside, r["items"]) in by[r.doc_id], r
        assert r.n_hit == len(inside) and all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:]))


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_table_against_every_place(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    rows = winnow.find(docs, items).collect()
    check([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()], rows)
    assert any(r.n_hit for r in rows)


@pytest.mark.parametrize("window", [1, 2, 3, 10])
def test_few_words_and_short_items(spark, window):
    """Texts of so few different words that windows, repeats and overlaps are everywhere."""
    rng = random.Random(window)
    text = lambda n, many: " ".join(rng.choice("abcdefgh"[:many]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 60), 3)) for i in range(60)]
    items = [(i, text(rng.choice([0, 1, 2, 4, 5, 7, 9, 10, 11, 14]), rng.choice([2, 3, 6]))) for i in range(24)]
    items += [(3, text(12, 2)), (100, items[5][1]), (None, text(10, 2))]
    check(docs, items, winnow.find(*tables(spark, docs, items), window=window).collect(), window)


def test_case_and_separators(spark):
    item = "One two,three — FOUR five\tsix; seven eight nine ten élan 字x É"
    docs = [
        (1, "x one TWO three—four five six seven eight nine ten y"), (2, "one two three — four five six seven eight nine ten"),
        (3, item.replace(" ", "\n- ")), (4, "seven eight nine ten élan 字x é"), (5, "z" * 50_000 + " " + item), (6, item + item),
    ]
    check(docs, [(1, item), (2, "ten")], winnow.find(*tables(spark, docs, [(1, item), (2, "ten")])).collect())


def test_every_shared_window_keeps_a_common_gram():
    rng = random.Random(4)
    for window in range(1, 14):
        shared = " ".join(rng.choice("abc") * 3 for _ in range(window))
        out = []
        for _ in range(2):
            text = " ".join([*(rng.choice("defabc") for _ in range(rng.randrange(30))), shared, *(rng.choice("defabc") for _ in range(rng.randrange(30)))])
            data = np.frombuffer(f"abc def{text}q".encode(), np.uint8)
            offsets = np.array([0, 7, 7 + len(text), len(data)])
            begins, ends, first = winnow.tokens(data, offsets)
            assert np.diff(first).tolist() == [2, len(text.split()), 1]
            out.append(set(winnow.kept(winnow.hashes(data, begins, ends, winnow.Powers()), first, window)[1].tolist()))
        assert out[0] & out[1]


def test_a_word_has_one_hash_wherever_it_stands():
    data = np.frombuffer(b"alpha beta Alpha gamma beta", np.uint8)
    for _ in range(2):
        powers = winnow.Powers()
        begins, ends, _ = winnow.tokens(data, np.array([0, len(data)]))
        a, b, c, d, e = winnow.hashes(data, begins, ends, powers).tolist()
        assert a == c and b == e and len({a, b, d}) == 3
        up, down = powers.of(100)
        assert (up * down == 1).all() and len(set(up.tolist())) == 100


def test_a_passage_that_many_documents_and_items_share(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"doc{i} begins {passage} and ends {i}") for i in range(3000)]
    items = [(i, passage if i < 200 else f"{passage} item {i}") for i in range(300)]
    rows = winnow.find(*tables(spark, docs, items)).collect()
    assert len(rows) == 3000
    for r in rows:
        assert r.n_hit == 30 and len(r["items"]) == 300 and [(s.begin, s.end) for s in r.spans] == [(2, 32)]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "sat on the MAT and then it slept all day"), (None, None), (2, ""), (3, " - "), (4, "identifier"), (4, "élan")],
        "item_id long, text string",
    )
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    rows = winnow.find(odd, items).collect()
    check(docs, [tuple(r) for r in items.collect()], rows)
    assert sum(r.n_hit for r in rows) == 3 * 10 + 2 + 1
    assert {r.n_hit for r in winnow.find(odd, items.limit(0)).collect()} == {0} and winnow.find(none, items).count() == 0
    renamed = odd.withColumnRenamed("size", "hits").withColumnRenamed("fp", "d").withColumnRenamed("lang", "h")
    left = winnow.decontaminate(renamed, items)
    assert left.columns == renamed.columns and sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7]


def test_query(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op12_decontamination(spark, SF).collect()}
    for d, t in docs:
        n, hit, found = plain(t, items)
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        assert tuple(got[d]) == (d, n, len(hit), len(found), digest, bool(hit))
