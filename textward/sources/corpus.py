"""From a source's raw rows to labelled corpus rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textward.functions.labels import resolve_label, resolve_language
from textward.functions.text import clip, is_blank
from textward.sources.catalogue import FILE, FORCED, ROW, SourceSpec

CORPUS_COLUMNS = ["pos", "text", "label", "source", "lang", "length"]


def apply_filter(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Keeps rows of the wanted role (a null role is not it) and, if asked, without a parent."""
    role = spec.filter.get("role")
    if role:
        df = df.filter(F.col("role") == role) if "role" in df.columns else df.filter(F.lit(False))
    if spec.filter.get("parent_id_is_null") and "parent_id" in df.columns:
        df = df.filter(F.col("parent_id").isNull())
    return df


def row_order(df: DataFrame, priority: int, key: str | None = None) -> Column:
    """STRUCT<priority, file, row>: catalogue order first, then the order inside the source.

    Both come from the data, so a task that runs again finds the same order.
    """
    if key is None and ROW not in df.columns:
        raise ValueError("rows that do not come from files need a key column for their order")
    file = F.lit("") if key is not None else F.col(FILE)
    row = F.col(key) if key is not None else F.col(ROW)
    return F.struct(F.lit(priority).alias("priority"), file.alias("file"), row.cast("bigint").alias("row"))


def label_rows(
    df: DataFrame,
    spec: SourceSpec,
    order: Column,
    max_text_chars: int | None = None,
) -> DataFrame:
    """Every row left by the filter, as corpus columns plus ``kept``.

    A row is skipped when its text is not a string or is blank, or when it has no label. Texts stay
    whole unless ``max_text_chars`` is given.
    """
    df = apply_filter(df, spec)
    fields = {f.name: f.dataType for f in df.schema.fields}

    def column(name: str | None) -> Column | None:
        return F.col(name) if name and name in fields else None

    is_text = isinstance(fields.get(spec.text_field), T.StringType)
    text = F.col(spec.text_field) if is_text else F.lit(None).cast("string")
    label = resolve_label(
        column(spec.label_field),
        fields.get(spec.label_field),
        column(FORCED),
        spec.fixed_label,
        spec.label_map,
        list(spec.drop_label_values),
    )
    lang = resolve_language(column(spec.language_field), spec.language, column("lang"))
    has_text = text.isNotNull() & ~is_blank(text)
    return df.select(
        order.alias("pos"),
        clip(text, max_text_chars).alias("text"),
        label.alias("label"),
        F.lit(spec.name).alias("source"),
        lang.alias("lang"),
        F.coalesce(has_text & label.isNotNull(), F.lit(False)).alias("kept"),
    )


def corpus_rows(labelled: DataFrame) -> DataFrame:
    """The kept rows in the corpus's columns."""
    return labelled.filter("kept").select(
        "pos", "text", "label", "source", "lang", F.length("text").alias("length")
    )


def concatenate(sources: Sequence[DataFrame]) -> DataFrame:
    """All sources after one another; ``pos`` carries the order."""
    return reduce(DataFrame.unionByName, sources)
