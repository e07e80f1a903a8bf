"""Pieces by longest match, against a matcher that tries every piece at every place."""

import random

from pyspark.sql import functions as F

from textward.operators import subwords

PIECES = ["a", "b", "ab", "abc", "bc</w>", "c</w>", "abcab", "x</w>", "the</w>", "th", "e", "é", "</w>"]


def plain_pieces(word):
    out = []
    while word:
        fits = [p for p in PIECES if not p.endswith("</w>") and word.startswith(p)]
        fits += [p[:-4] for p in PIECES if p.endswith("</w>") and p[:-4] == word and p != "</w>"]
        best = max(fits, key=len, default=word[0])
        out.append(best)
        word = word[len(best) :]
    return out


def test_words_against_every_piece():
    rng, cut = random.Random(4), subwords.cutter(PIECES)
    for _ in range(2000):
        word = "".join(rng.choice("abcxtheéz") for _ in range(rng.randrange(0, 12)))
        assert cut(word) == plain_pieces(word)
    assert subwords.cutter([])("abc") == ["a", "b", "c"]


def test_texts(spark):
    texts = ["the abc", "", None, " \n ", "THE the abcabc", "a b a　b", "x" * 5000, "a b " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    count = subwords.counter(spark, PIECES)
    got = {r["i"]: r["n"] for r in df.select("i", count(F.col("text")).alias("n")).collect()}
    for i, text in enumerate(texts):
        words = [w for w in (text or "").lower().replace("\n", " ").split(" ") if w]
        assert got[i] == (None if text is None else sum(len(plain_pieces(w)) for w in words)), text


def test_a_vocabulary_file(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"model": {"vocab": {"a": 0, "b</w>": 1}}}')
    assert subwords.read_pieces(spark, str(tmp_path / "v.json")) == ["a", "b</w>"]
