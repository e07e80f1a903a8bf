"""English/Spanish routing of a prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textward.functions import text as T
from textward.functions.planning import bind

# Spanish hint words and marker characters, confidences and thresholds.
SPANISH_HINT_WORDS = (
    "ayuda", "bueno", "buenos", "esta", "este", "gracias", "gusta", "hola", "mucho", "no",
    "producto", "recomiendo", "respuesta", "soporte",
)
SPANISH_MARKERS = "áéíóúñ¿¡"
MARKER_CONFIDENCE = 0.95
WORD_CONFIDENCE = 0.75
LONG_TEXT_WORDS = 5
CONFIDENCE_THRESHOLD = 0.6

Detector = Callable[[Column], Column]


def heuristic_detector(text: Column) -> Column:
    """STRUCT<lang, confidence>: marker characters first, then hint words, then English."""

    def found(lang: str, confidence: float) -> Column:
        return F.struct(F.lit(lang).alias("lang"), F.lit(confidence).alias("confidence"))

    def look(low: Column) -> Column:
        return (
            F.when(low.rlike(f"[{SPANISH_MARKERS}]"), found("es", MARKER_CONFIDENCE))
            .when(T.contains_word(low, SPANISH_HINT_WORDS), found("es", WORD_CONFIDENCE))
            .when(low.rlike(f"[{T.LATIN}]"), found("en", WORD_CONFIDENCE))
            .otherwise(found("en", 0.0))
        )

    return bind(F.lower(text), look)


def long_text_detector(text: Column, detector: Detector = heuristic_detector) -> Column:
    """Long texts are flattened to one line first; blank ones are English at 0.0."""
    nothing = F.struct(F.lit("en").alias("lang"), F.lit(0.0).alias("confidence"))
    return F.when(T.is_blank(text), nothing).otherwise(detector(T.single_line(text)))


def detect(
    text: Column,
    preferred: Column | str = "en",
    history: Column | None = None,
    threshold: float = CONFIDENCE_THRESHOLD,
    short_detector: Detector = heuristic_detector,
    long_detector: Detector = heuristic_detector,
) -> Column:
    """STRUCT<lang, confidence, method> for a prompt.

    Fewer than two Latin letters fall back at once. Otherwise the word count picks the
    detector, every language but Spanish becomes English, and low confidence falls back to
    the conversation's earlier language or, without one, to the preferred language.
    """
    preferred = preferred if isinstance(preferred, Column) else F.lit(preferred)
    # An empty history counts as absent.
    fallback = preferred if history is None else F.coalesce(F.nullif(history, F.lit("")), preferred)
    is_long = T.has_more_words_than(text, LONG_TEXT_WORDS)
    method = F.when(is_long, F.lit("fasttext")).otherwise(F.lit("lingua"))
    cleaned = T.strip(text)
    if short_detector is heuristic_detector and long_detector is heuristic_detector:
        # Both look only at letters and markers, which stripping and flattening leave alone.
        found = heuristic_detector(text)
    else:
        found = F.when(is_long, long_text_detector(cleaned, long_detector)).otherwise(
            short_detector(cleaned)
        )

    def decide(hit: Column) -> Column:
        sure = hit["confidence"] >= threshold
        return F.struct(
            F.when(~sure, fallback).when(hit["lang"] == "es", F.lit("es")).otherwise(F.lit("en")).alias("lang"),
            F.round(hit["confidence"], 4).alias("confidence"),
            F.when(sure, method).otherwise(F.concat(F.lit("fallback_"), method)).alias("method"),
        )

    no_letters = F.struct(
        fallback.alias("lang"),
        F.lit(0.0).alias("confidence"),
        F.lit("fallback_no_alpha").alias("method"),
    )
    return F.when(T.has_two_latin_letters(text), bind(found, decide)).otherwise(no_letters)


def target(lang: Column, english: Column | str, spanish: Column | str) -> Column:
    """The label of the filter a language is sent to."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.when(lang == "es", lit(spanish)).otherwise(lit(english))


def resolve_bucket(lang: Column, configured: list[str]) -> Column:
    """The configured language bucket for a routed language: itself, else en, else the first."""
    if not configured:
        return lang
    default = "en" if "en" in configured else configured[0]
    return F.when(lang.isin(*configured), lang).otherwise(F.lit(default))


def route_detail(route: Column) -> Column:
    """One line describing a STRUCT<lang, confidence, method, target>."""
    return F.format_string(
        "Input language router: %s (%.4f, %s) -> %s",
        route["lang"], route["confidence"], route["method"], route["target"],
    )
