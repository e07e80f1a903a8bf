import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from textward.llm import infill, queries

from .conftest import SF


def plain(doc_id, text):
    """(n, form, prefix, middle, output) by the definition, one text at a time."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(rows):
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.restored == (r.text or "")


def test_odd_rows(spark, odd, none):
    check(infill.restore(infill.transform(odd)).collect())
    assert infill.restore(infill.transform(none)).count() == 0
    renamed = odd.withColumnRenamed("size", "n").withColumnRenamed("fp", "row").withColumnRenamed("lang", "restored")
    done = infill.restore(infill.transform(renamed))
    assert done.columns == ["doc_id", "text", "source", "row", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    check(done.collect())


def test_many_short_texts_with_marks_and_wide_characters(spark):
    rng = random.Random(3)
    pieces = ["<P>", "<S>", "<M>", "<", ">", "P", "S>", "<P", "é", "字", "😀", " ", "\n", "word", "\x00"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(0, 12)))) for i in range(3000)]
    rows += [(i, "".join(rng.choice(pieces[3:]) for _ in range(rng.randrange(0, 12)))) for i in range(3000, 6000)]
    done = infill.restore(infill.transform(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(done) == 6000 and {r.form for r in done} == {"plain", "psm", "spm"}
    check(done)


def test_a_long_text_beside_short_ones(spark):
    rows = [(0, "a"), (1, "aé字" * 1_500_000), (2, ""), (3, "b" * 5)] + [(i, "xyz" * i) for i in range(4, 40)]
    check(infill.restore(infill.transform(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))).collect())


def test_outputs_that_no_text_gives(spark):
    rows = [
        ("psm", "<P>a<S>b<M>c", "acb"), ("spm", "<S>a<P>b<M>c", "bca"), ("psm", "<S>a<P>b<M>c", None), ("psm", "x<P>a<S>b<M>c", None),
        ("psm", "<P>a<S>b", None), ("psm", "<P>a<S>b<M>c<M>", None), ("plain", "<P>", "<P>"), ("other", "a", None), (None, "a", None),
        ("psm", None, None), ("psm", "", None), ("psm", "<P><S><M>", ""), ("plain", "", ""),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, form string, output string, want string").coalesce(1)
    for r in infill.restore(df).collect():
        assert r.restored == r.want, r


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=6), st.integers(0, 2**31))
def test_any_texts(texts, seed):
    rng = np.random.default_rng(seed)
    raw = [t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    digits = rng.integers(0, 2**32, (len(raw), 4))
    n, form, _, _, out, out_offsets = infill.cut(data, offsets, digits, 90, 20)
    back, back_offsets, valid = infill.join(out, out_offsets, form)
    assert valid.all() and back.tobytes() == data.tobytes() and (back_offsets == offsets).all()
    assert n.tolist() == [len(r.decode()) for r in raw]


def test_query(spark):
    rows = queries.op13_infill(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert len(rows) == len(docs)
    for r in rows:
        n, form, prefix, middle, output = plain(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (
            n, form, prefix, middle, sha(output), sha(docs[r.doc_id])
        )
