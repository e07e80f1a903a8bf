import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from textward.llm import bpe
from textward.llm.queries import QUERIES

from .conftest import SF

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.load_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_same_ids_as_the_library(vocabulary, library):
    rng = random.Random(5)
    letters = "ab'stredlvmT12 \t\n\r\x0b\x1c\x85 　é字ß²٣!?.😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(50))) for _ in range(4000)]
    texts += ["", "'", "'s", "''s", " 'll", "x" * 5000, " " * 4000, "don't DON'T we've", "\n\n a\n", "ab" * 3000]
    assert list(vocabulary.encode(texts)) == library.encode_ordinary_batch(texts, num_threads=2)


def test_rows_end_anywhere(vocabulary, library):
    """Boundaries do not depend on where the rows of the scan begin."""
    for n in range(60, 70):
        text = "a" * n + "'re " + " " * n + "b1"
        assert next(vocabulary.encode([text])) == library.encode_ordinary(text)


def test_short_and_long_merges_agree(vocabulary):
    rng = random.Random(6)
    pieces = ["".join(rng.choice("thenigabcäö") for _ in range(rng.randrange(1, 20))).encode() for _ in range(500)]
    assert vocabulary.merge_all(pieces) == [vocabulary.merge_long(p) for p in pieces]


def test_a_full_cache_changes_nothing(library):
    small = bpe.Vocabulary(bpe.load_ranks(PATH), keep=3)
    texts = ["one two three four five six", "seven one eight two", "zxqv zxqw zxqy"]
    for _ in range(2):
        assert list(small.encode(texts)) == library.encode_ordinary_batch(texts)


def test_query_and_round_trip(spark, library):
    got = {r.doc_id: r for r in QUERIES["op10_byte_bpe"](spark, SF).collect()}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(text)
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_rows(spark, odd, none, library):
    encoded = bpe.decode(bpe.encode(odd.withColumnRenamed("size", "token_ids"), PATH), PATH).collect()
    assert len(encoded) == 11
    for r in encoded:
        text = r.text or ""
        assert r.token_ids == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
        cuts = zip(r.token_offsets, r.token_offsets[1:])
        assert [text.encode()[a:b] for a, b in cuts] == [library.decode_single_token_bytes(i) for i in r.token_ids]
    assert bpe.encode(none, PATH).count() == 0
