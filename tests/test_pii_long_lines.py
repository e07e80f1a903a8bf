"""Patterns of a keyword, anything and a token: the same matches as Python's, in time that grows with the text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textward.functions import pii
from textward.functions.pii_patterns import PII_PATTERNS

KEYWORD_AND_TOKEN = {
    "Facebook OAuth": ("facebook", f"'{'0a' * 16}'"),
    "GitHub": ("GitHub", f"\"{'a1' * 18}\""),
    "Generic API Key": ("api key", f"'{'b2' * 17}'"),
    "Generic Secret": ("SECRET", f"\"{'c3' * 20}\""),
    "Heroku API Key": ("heroku", "ABCDEF01-2345-6789-ABCD-EF0123456789"),
    "Twitter Access Token": ("twitter", f"90-{'d4' * 20}"),
    "Twitter OAuth": ("tWitter", f"'{'e5' * 20}'"),
}


def test_these_are_all_such_patterns():
    assert set(KEYWORD_AND_TOKEN) == set(pii.TO_LINE_END)


def matches(entity, text):
    return [m.group(0) for m in re.finditer(PII_PATTERNS[entity], text, re.IGNORECASE)]


def masked(entity, text):
    return re.sub(PII_PATTERNS[entity], lambda m: "*" * len(m.group(0)), text, flags=re.IGNORECASE)


def test_lines_with_and_without_tokens_against_re(spark):
    rng = random.Random(3)
    rows = []
    for entity, (keyword, token) in KEYWORD_AND_TOKEN.items():
        for _ in range(60):
            parts = [rng.choice([keyword, keyword, token, token[:-1], " ", "x", "\n", "\r", " ", "=", "'"]) for _ in range(rng.randrange(1, 14))]
            rows.append((entity, "".join(parts)))
    df = spark.createDataFrame(rows, "entity string, text string")
    for entity in KEYWORD_AND_TOKEN:
        mine = df.where(F.col("entity") == entity)
        found = F.filter(F.regexp_extract_all("text", F.lit(pii.java_regex(entity)), F.lit(1)), lambda m: m != "")
        for r in mine.select("text", found.alias("found"), pii.found_in(F.col("text"), entity).alias("any")).collect():
            want = matches(entity, r.text)
            assert (r.found, r.any) == (want, bool(want)), (entity, r.text)
    got = {(r.text, e) for r in pii.scan(df).collect() for e in r.entities if e in KEYWORD_AND_TOKEN}
    assert got == {(t, e) for _, t in rows for e in KEYWORD_AND_TOKEN if matches(e, t)}


def test_masks_leave_what_is_no_match(spark):
    keyword, token = KEYWORD_AND_TOKEN["GitHub"]
    text = f"a {keyword} x {token} tail {keyword} none\n{keyword} {keyword} nothing\nb {keyword}{token}{keyword} {token}."
    r = pii.mask(spark.createDataFrame([(text,)], "text string")).first().masked
    assert r.text == masked("GitHub", text) and r.masked_entities == ["GitHub"]
    nothing = f"{keyword} and \"{token[1:10]}\" and {keyword}"
    assert pii.mask(spark.createDataFrame([(nothing,)], "text string")).first().masked.text == nothing


@pytest.mark.parametrize("entity", sorted(KEYWORD_AND_TOKEN))
def test_many_keywords_on_one_line(spark, entity):
    keyword, token = KEYWORD_AND_TOKEN[entity]
    texts = [f"{keyword} " * 20_000 + "' - 11", f"{keyword} {token} " + f"{keyword} " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    query = df.select(F.sum(pii.found_in(F.col("text"), entity).cast("int")))
    query.collect()
    began = time.time()
    assert query.first()[0] == 1
    assert time.time() - began < 5  # a quadratic search takes minutes
    r = pii.mask(df).select(F.substring("masked.text", 1, 10).alias("head"), F.length("masked.text").alias("n")).collect()
    assert sorted(x.head for x in r) == sorted([texts[0][:10], "*" * 10]) and sorted(x.n for x in r) == sorted(map(len, texts))
