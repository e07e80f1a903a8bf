"""What several operators share: words, row checks and stable random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that parts words: space and U+0009 to U+000D, nothing else.
WORD_GAP = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_GAP))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[ \t-\r]+")
    )


def word_count(text: Column) -> Column:
    """Number of words, zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """The text with A to Z in lower case and every other character as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def byte_words(text: str | None) -> list[bytes]:
    """Lower-cased (A to Z) words of a text as UTF-8; bytes.split parts at the same six characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed alone; 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"#{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns, so that other columns, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
