"""Text scalars: whitespace, truncation, letters, words and preprocessing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.functions.planning import bind

# Characters Python counts as whitespace: Unicode White_Space plus the four separators.
# For patterns with the flag U, under which \\s is all of Unicode's whitespace.
SPACE = r"\s\x1c-\x1f"
NOT_SPACE = r"[^\s\x1c-\x1f]"
LATIN = r"a-zA-ZÀ-ɏ"

# The attack vocabulary of the tagging preprocessor, one list per tag.
OVERRIDE_WORDS = ("ignore", "disregard", "forget", "override", "bypass", "skip", "discard", "dismiss")
SYSTEM_WORDS = ("system", "instruction", "prompt", "directive", "guideline", "rule", "constraint")
ROLEPLAY_WORDS = (
    "pretend", "imagine", r"act\s+as", "roleplay", "role-play", "simulate", "hypothetically",
    r"as\s+if", "dan", "jailbreak",
)
ATTACK_TAGS = {
    "__OVERRIDE__": OVERRIDE_WORDS,
    "__SYSTEM__": SYSTEM_WORDS,
    "__ROLEPLAY__": ROLEPLAY_WORDS,
}


def _strip_short(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z", "")


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode whitespace.

    Only a text that begins or ends with some is searched, since most do not.
    """
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(rf"(?U)[{SPACE}]"), _strip_short(text)).otherwise(text)


def is_blank(text: Column) -> Column:
    """True when nothing but whitespace is left; stops at the first other character."""
    return ~text.rlike(rf"(?U){NOT_SPACE}")


def normalize_whitespace(text: Column) -> Column:
    """One space between words and none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U)[{SPACE}]+", " "))


def clip(text: Column, max_chars: int | None = None) -> Column:
    """The stripped text; if asked, its first ``max_chars`` code points (not stripped again)."""
    whole = strip(text)
    return whole if max_chars is None else F.substring(whole, 1, max_chars)


def near_duplicate_key(text: Column, prefix_chars: int | None = None) -> Column:
    """SHA-256 of the lower-cased, stripped text; if asked, of its first ``prefix_chars`` code points."""
    part = text if prefix_chars is None else F.substring(text, 1, prefix_chars)
    return F.sha2(strip(F.lower(part)), 256)


def latin_letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{LATIN}]", ""))


def has_two_latin_letters(text: Column) -> Column:
    """Same as ``latin_letter_count(text) >= 2``, but stops at the second letter."""
    return text.rlike(f"[{LATIN}][^{LATIN}]*+[{LATIN}]")


def word_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for blank text."""
    return F.regexp_count(text, F.lit(rf"(?U){NOT_SPACE}+"))


def has_more_words_than(text: Column, n: int) -> Column:
    """Same as ``word_count(text) > n``, but stops after ``n + 1`` words."""
    word = rf"{NOT_SPACE}++"
    return text.rlike(rf"(?U){word}(?:[{SPACE}]++{word}){{{n}}}")


def latin_words(text: Column) -> Column:
    """Distinct lower-cased runs of Latin letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"[{LATIN}]+"), F.lit(0)))


def contains_word(low: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether a lower-cased text has any of the words among its runs of Latin letters.

    The same as looking them up in ``latin_words``, without building the array.
    """
    return low.rlike(f"(?<![{LATIN}])(?:{'|'.join(words)})(?![{LATIN}])")


def single_line(text: Column) -> Column:
    """Newlines become spaces, then strip."""
    return strip(F.translate(text, "\n", " "))


def _one_space(ascii_text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_text, r"[\s\x1c-\x1f]+", " "))


def _ascii_lower(text: Column) -> Column:
    """Non-ASCII runs become a space, then one space between words, then lower case.

    Doing this before the tags are put in rather than after changes nothing: the lists ignore
    case, hold only ASCII words, and allow any whitespace inside a phrase.
    """
    return F.lower(_one_space(F.regexp_replace(text, r"[^\x00-\x7F]+", " ")))


def _has_attack_word(low: Column, words: tuple[str, ...]) -> Column:
    """Whether a word list can match; plain searches, cheaper than the word-bounded pattern."""
    return reduce(Column.__or__, [F.contains(low, F.lit(w.replace(r"\s+", " "))) for w in words])


def _attack_regex(words: tuple[str, ...]) -> str:
    return rf"\b(?:{'|'.join(words)})\b"


def tag_attack_words(text: Column) -> Column:
    """Drop non-ASCII runs, replace attack words by their tag in tag order, collapse, lower."""
    out = _ascii_lower(text)
    for tag, words in ATTACK_TAGS.items():
        out = bind(out, _tagging(tag, words))
    return out


def _tagging(tag: str, words: tuple[str, ...]) -> Callable[[Column], Column]:
    def replace(low: Column) -> Column:
        tagged = F.regexp_replace(low, _attack_regex(words), f" {tag.lower()} ")
        return F.when(_has_attack_word(low, words), _one_space(tagged)).otherwise(low)

    return replace


def attack_tag_flags(text: Column) -> Column:
    """The tags ``tag_attack_words`` puts in, in tag order.

    No tag holds a word of another list between word boundaries, so each list can be looked for
    in the text itself.
    """
    return bind(
        _ascii_lower(text),
        lambda low: F.array_compact(
            F.array(
                *[
                    F.when(_has_attack_word(low, words) & low.rlike(_attack_regex(words)), F.lit(tag))
                    for tag, words in ATTACK_TAGS.items()
                ]
            )
        ),
    )


Preprocessor = Callable[[Column], Column]

PREPROCESSORS: dict[str, Preprocessor] = {
    "identity": lambda text: text,
    "normalize_whitespace": normalize_whitespace,
    "tag_attack_words": tag_attack_words,
}
