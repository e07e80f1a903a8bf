"""The trained detector against the same sums in plain Python, and its accuracy on texts it has not seen."""

import math
import re
from collections import Counter

from textward.operators import language_model as L

EN = ["the quick brown fox jumps over the lazy dog", "this is what they said about the other thing", "where are those that think with us"]
ES = ["el perro que come en la casa de los otros", "esta es la cosa que ellos dicen", "donde estan los que piensan con nosotros"]
TRAIN = [(i, t, lang) for i, (t, lang) in enumerate([(t, "en") for t in EN] + [(t, "es") for t in ES] + [("xyz xyz", None)])]


def plain_grams(text):
    if text is None:
        return []
    plain = " " + re.sub(r"[ \t\n\x0b\f\r]+", " ", text.lower()).strip(" ") + " "
    return [plain[i : i + 3] for i in range(len(plain) - 2)]


def plain_scores(text, rows):
    counts = {}
    for _, t, lang in rows:
        if lang:
            counts.setdefault(lang, Counter()).update(plain_grams(t))
    kinds = len({g for c in counts.values() for g in c})
    out = {}
    for lang, c in counts.items():
        total = round(math.log(sum(c.values()) + kinds) * L.SCALE)
        out[lang] = sum((round(math.log(c[g] + 1) * L.SCALE) if c[g] else 0) - total for g in plain_grams(text))
    return out


def test_against_plain_sums(spark):
    texts = [*EN, *ES, "the other thing", "la cosa", "zzz qqq", "", "  ", None, "a", "él 字 dijo", "THE\n\nDOG"]
    train = spark.createDataFrame(TRAIN, "id long, text string, lang string")
    weights, totals = L.train(train)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r for r in L.detect(docs, weights, totals, "id").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        runs, scores = len(plain_grams(text)), plain_scores(text, TRAIN)
        (best, lang), (second, _) = sorted(((-s, k) for k, s in scores.items()))[:2]
        sure = runs > 0 and second - best >= 20_000 * runs
        assert got[i]["lang"] == (lang if sure else None), text
        assert (got[i]["margin"] is None) if not runs else math.isclose(got[i]["margin"], (second - best) / (runs * L.SCALE), abs_tol=1e-9)


def test_texts_it_has_not_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    weights, totals = L.train(docs.where("doc_id % 2 = 0"))
    rows = L.detect(docs.where("doc_id % 2 = 1"), weights, totals, "doc_id").join(
        docs.selectExpr("doc_id", "lang as label"), "doc_id"
    ).collect()
    told = [r for r in rows if r["lang"]]
    assert len(told) > 0.8 * len(rows) and sum(r["lang"] == r["label"] for r in told) > 0.95 * len(told)


def test_tables_without_rows_or_languages(spark):
    docs = spark.createDataFrame([(1, "some text")], "id long, text string")
    weights, totals = L.train(spark.createDataFrame([(1, "a b", None)], "id long, text string, lang string"))
    assert [tuple(r) for r in L.detect(docs, weights, totals, "id").collect()] == [(1, None, None)]
    one = L.train(spark.createDataFrame([(1, "a b", "en")], "id long, text string, lang string"))
    assert [(r["lang"], r["margin"]) for r in L.detect(docs, *one, "id").collect()] == [("en", None)]
    assert L.detect(docs.limit(0), *one, "id").count() == 0
