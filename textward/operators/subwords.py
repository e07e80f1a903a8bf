"""Counting the pieces a vocabulary cuts texts into, longest match first."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# What marks a piece that ends a word.
WORD_END = "</w>"
# Pieces a vocabulary may have, which bounds what is sent to every worker, and words whose count a worker keeps.
MOST_PIECES = 1 << 20
KEPT_WORDS = 1 << 18


def read_pieces(spark: SparkSession, path: str) -> list[str]:
    """The pieces of a vocabulary file: JSON with ``model.vocab``, as tokenizer libraries write it."""
    document = json.loads(spark.read.text(path, wholetext=True).first()[0])
    pieces = list(document["model"]["vocab"])
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"a vocabulary has {MOST_PIECES} pieces at most, this one {len(pieces)}")
    return pieces


def cutter(pieces: Iterable[str], end: str = WORD_END) -> Callable[[str], list[str]]:
    """word -> its pieces. Each is the longest that the vocabulary has at that place; at the word's end one that
    ends words goes before a plain one of the same characters. A character that no piece begins with is one."""
    plain = {p for p in pieces if not p.endswith(end)}
    final = {p[: -len(end)] for p in pieces if p.endswith(end)}
    longest = max(map(len, plain | final), default=1)

    def cut(word: str) -> list[str]:
        out, at, n = [], 0, len(word)
        while at < n:
            for size in range(min(longest, n - at), 0, -1):
                part = word[at : at + size]
                if part in plain or (at + size == n and part in final):
                    break
            else:
                size = 1
            out.append(word[at : at + size])
            at += size
        return out

    return cut


def counter(spark: SparkSession, pieces: Iterable[str], end: str = WORD_END) -> Callable[[Column], Column]:
    """text -> number of pieces, all words of whole texts in lower case; null for null.

    The vocabulary is sent to each worker once; a worker cuts a word once and keeps its count, of a bounded number
    of words. Words are parted by white space.
    """
    shared = spark.sparkContext.broadcast(list(pieces))

    def count_batches(batches):
        import pandas as pd

        cut, known = cutter(shared.value, end), {}

        def count(text):
            total = 0
            for word in text.split():
                n = known.get(word)
                if n is None:
                    n = len(cut(word))
                    if len(known) < KEPT_WORDS:
                        known[word] = n
                total += n
            return total

        for batch in batches:
            yield pd.Series([None if t is None else count(t) for t in batch], dtype="Int64")

    import pandas as pd

    count_batches.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(count_batches, "bigint")
    # Other white space than these six characters belongs to words: it is written so that split() leaves it alone.
    return lambda text: udf(F.translate(F.lower(text), _OTHER_SPACE, _STAND_IN))


# What Python's split() takes for white space besides space and U+0009 to U+000D, and as many
# characters of private use in their place.
_OTHER_SPACE = (
    "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_STAND_IN = "".join(chr(0xE000 + i) for i in range(len(_OTHER_SPACE)))
