"""Finding and masking personal data and secrets with JVM regular expressions only.

Both jobs look first at what a pattern needs (``NEEDS``): a text without a digit, an ``@`` or
a known token prefix never reaches most of the 51 regular expressions. The tests compare the
result with Python's ``re`` on strings for every type and on random strings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.functions.pii_patterns import MARKS, NEEDS, PII_PATTERNS, Needs
from textward.functions.planning import bind, evaluate_here

# i: ignore case; u: in all of Unicode; U: Unicode \d \w \s \b; d: only \n ends a line for "."
FLAGS = "(?iuUd)"

_EMAIL_CHARS = r"[a-zA-Z0-9.\-+_]"

# The same matches at bounded cost on very long texts:
#  - an e-mail's local part can only begin where a run of its characters begins, or where the
#    last match ended, so other starting points in a long run need not be tried;
#  - the host of a URL is followed by nothing, so its loop need not keep positions to return to;
#  - ".*x" always begins its match at the start of a line.
_JAVA_FORMS = {
    "EMAIL_ADDRESS": rf"(?:\G|(?<!{_EMAIL_CHARS}))" + PII_PATTERNS["EMAIL_ADDRESS"],
    "URL": r"https?://(?:[-\w.]++|(?:%[\da-fA-F]{2})++)+",
    "Firebase URL": "(?m)^" + PII_PATTERNS["Firebase URL"],
}


# Patterns of a keyword, anything, and a token at its end. If no token follows the first keyword of a line, none
# follows the others: so a match that takes the rest of the line, and is none, keeps them from being tried.
TO_LINE_END = (
    "Facebook OAuth", "GitHub", "Generic API Key", "Generic Secret", "Heroku API Key", "Twitter Access Token", "Twitter OAuth",
)


def java_regex(entity: str) -> str:
    """The pattern of an entity type as Spark's regular expression functions take it.

    For TO_LINE_END, group 1 is the match, and a match without it is the rest of a line that has none.
    """
    pattern = _JAVA_FORMS.get(entity, PII_PATTERNS[entity])
    if entity in TO_LINE_END:
        pattern = f"({pattern})|{pattern.split('.*')[0]}.*"
    return FLAGS + pattern


def folded(text: Column) -> Column:
    """Lower case, with the four letters that equal an ASCII letter when case is ignored."""
    out = text
    for letter, same_as in (("ſ", "s"), ("ı", "i"), ("İ", "i"), ("K", "k")):
        out = F.replace(out, F.lit(letter), F.lit(same_as))
    return F.lower(out)


def digit_run(text: Column) -> Column:
    """0, 1, 2 or 4: the longest of these runs of digits the text has."""
    return (
        F.when(~text.rlike(r"(?U)\d"), 0)
        .when(~text.rlike(r"(?U)\d{2}"), 1)
        .when(~text.rlike(r"(?U)\d{4}"), 2)
        .otherwise(4)
    )


def _has_any(fold: Column, literals: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(fold, F.lit(s)) for s in literals])


_CLUES, _WORTH = "__pii_clues", "__pii_worth"
_DISTINCT_NEEDS = list(dict.fromkeys(NEEDS.values()))


def _worth(entity: str) -> Column:
    """Whether the text has what the pattern of an entity type needs."""
    return F.col(_WORTH)[f"w{_DISTINCT_NEEDS.index(NEEDS[entity])}"]


def with_clues(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds one flag per distinct need, which ``scan`` and ``mask`` test before a regex.

    Projections of their own, so that Spark folds a text once and evaluates a flag once.
    """
    source = F.col(text)
    fold = folded(source)
    clues = df.withColumn(_CLUES, F.struct(fold.alias("fold"), digit_run(source).alias("run")))
    seen = F.col(_CLUES)
    marks = [_has_any(seen["fold"], literals).alias(mark) for mark, literals in MARKS.items()]
    marked = clues.withColumn(_CLUES, F.struct(seen["fold"].alias("fold"), seen["run"].alias("run"), *marks))

    def met(needs: Needs) -> Column:
        tests = [seen[mark] for mark in needs.marks]
        if needs.digits:
            tests.append(seen["run"] >= needs.digits)
        if needs.any_of:
            tests.append(_has_any(seen["fold"], needs.any_of))
        return reduce(Column.__and__, tests)

    flags = [met(needs).alias(f"w{i}") for i, needs in enumerate(_DISTINCT_NEEDS)]
    return marked.withColumn(_WORTH, F.struct(*flags)).drop(_CLUES)


def found_in(text: Column, entity: str) -> Column:
    """Whether a text has a match of an entity type."""
    regex = java_regex(entity)
    if entity in TO_LINE_END:
        return F.exists(F.regexp_extract_all(text, F.lit(regex), F.lit(1)), lambda m: m != "")
    return text.rlike(regex)


def _scan_with(text: Column) -> Column:
    hits = [F.when(_worth(e) & found_in(text, e), F.lit(e)) for e in PII_PATTERNS]
    return F.when(text.isNotNull(), F.array_compact(F.array(*hits)))


def _mask_with(text: Column, mask_char: str, guarded: bool) -> Column:
    entries = []
    for entity in PII_PATTERNS:
        entry = F.struct(
            F.lit(entity).alias("name"), F.lit(java_regex(entity)).alias("regex"), F.lit(entity in TO_LINE_END).alias("to_end")
        )
        if guarded:
            entry = F.when(_worth(entity), entry)
        entries.append(entry)
    candidates = F.array_compact(F.array(*entries))
    no_entities = F.array().cast("array<string>")

    def covered(source: Column, found: Column, real: Column, regex: Column) -> Column:
        between = F.split(source, regex, -1)
        stars = F.zip_with(found, real, lambda m, r: F.when(r == "", m).otherwise(F.repeat(F.lit(mask_char), F.length(m))))
        return F.array_join(
            F.zip_with(between, F.concat(stars, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""
        )

    def step(state: Column, entry: Column) -> Column:
        def put(matches: Column) -> Column:
            found, real = matches["found"], matches["real"]
            return F.when(~F.exists(real, lambda m: m != ""), state).otherwise(
                F.struct(
                    covered(state["text"], found, real, entry["regex"]).alias("text"),
                    F.concat(state["masked_entities"], F.array(entry["name"])).alias("masked_entities"),
                )
            )

        group = lambda g: F.regexp_extract_all(state["text"], entry["regex"], F.lit(g))
        return bind(group(0), lambda found: bind(
            F.struct(found.alias("found"), F.when(entry["to_end"], group(1)).otherwise(found).alias("real")), put
        ))

    start = F.struct(text.alias("text"), no_entities.alias("masked_entities"))
    return F.when(text.isNotNull(), F.aggregate(candidates, start, step))


def _guards_hold(mask_char: str) -> bool:
    """Whether masking cannot bring in anything a pattern needs."""
    literals = [s for n in NEEDS.values() for s in n.any_of]
    needed = "".join(literals + [s for m in MARKS.values() for s in m])
    return len(mask_char) == 1 and not mask_char.isalnum() and mask_char not in needed


def scan(df: DataFrame, text: str = "text", into: str = "entities") -> DataFrame:
    """Adds the entity types found in the original text, in pattern order."""
    return with_clues(df, text).withColumn(into, evaluate_here(_scan_with(F.col(text)))).drop(_WORTH)


def scan_result(entities: Column) -> Column:
    """STRUCT<passed, filter_name, confidence, latency_ms, detail> for a scan's entities."""
    clean = F.size(entities) == 0
    return F.struct(
        clean.alias("passed"),
        F.lit("PII").alias("filter_name"),
        F.when(clean, 0.0).otherwise(1.0).alias("confidence"),
        F.lit(0.0).alias("latency_ms"),
        F.when(clean, F.lit("No PII detected"))
        .otherwise(F.concat(F.lit("PII detected: "), F.array_join(entities, ", ")))
        .alias("detail"),
    )


def mask(df: DataFrame, text: str = "text", into: str = "masked", mask_char: str = "*") -> DataFrame:
    """Adds STRUCT<text, masked_entities>: every match becomes mask characters.

    The patterns run one after the other, each on the text the earlier ones left.
    """
    if not _guards_hold(mask_char):
        return df.withColumn(into, evaluate_here(_mask_with(F.col(text), mask_char, guarded=False)))
    return (
        with_clues(df, text)
        .withColumn(into, evaluate_here(_mask_with(F.col(text), mask_char, guarded=True)))
        .drop(_WORTH)
    )


def is_masked(result: Column) -> Column:
    return F.size(result["masked_entities"]) > 0


def entity_counts(df: DataFrame, entities: str = "entities") -> DataFrame:
    """How many rows have each entity type; counts are combined before the shuffle."""
    return (
        df.select(F.explode(entities).alias("entity"))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
