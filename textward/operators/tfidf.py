"""Term weights of texts, by joins: counts per document, document frequencies, and unit length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textward.functions.planning import SMALL
from textward.session import staged

TERM = r"[\p{L}\p{N}]+"


def term_counts(docs: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, term, n): how often each term, a run of letters and digits in lower case, is in each document.

    Texts are dealt by id and taken apart there: that moves less than their terms, and what is grouped by id
    afterwards need not move again.
    """
    dealt = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).repartition("id")
    return dealt.select("id", F.explode(_terms("text")).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


def _terms(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), 0)


def _terms_of_each(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(term) once for each document that has it. Texts stay where they are, but for those whose id comes again; if
    those ids are many, all are dealt by id."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    again = staged(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("again")), "again")
    n = again.count()
    if n > SMALL:
        return term_counts(rows, "id").select("term")
    if not n:
        return rows.select(F.explode(F.array_distinct(_terms("text"))).alias("term"))
    same = F.col("id").eqNullSafe(F.col("again"))
    alone = rows.join(F.broadcast(again), same, "left_anti").select(F.explode(F.array_distinct(_terms("text"))).alias("term"))
    return alone.union(term_counts(rows.join(F.broadcast(again), same, "left_semi"), "id").select("term"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(term, documents), counted on the map side first, as terms that are everywhere come in every task."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def fit(docs: DataFrame, id: str, text: str = "text", at_least: int = 1) -> DataFrame:
    """(term, idf) of the terms in ``at_least`` documents: ln((1 + all) / (1 + with the term)) + 1.

    All documents count, those without terms too. One table that later texts are weighed by.
    """
    n = docs.count()
    found = document_frequencies(_terms_of_each(docs, id, text)).where(F.col("documents") >= at_least)
    return found.select("term", (F.ln(F.lit(1.0 + n) / (F.col("documents") + 1)) + 1).alias("idf"))


def weights(docs: DataFrame, idf: DataFrame, id: str, text: str = "text") -> DataFrame:
    """(id, term, n, idf, weight) of the documents' terms that the table knows: count times idf, scaled so that each
    document's weights have unit length. A table of few terms is broadcast, so that the documents' terms stay
    where they are; a larger one is a plain equi-join by term, which splits those that are everywhere. What is
    grouped by id afterwards does not move."""
    known = staged(idf.select("term", "idf"), "idf")
    small = known.count() <= SMALL
    found = term_counts(docs, id, text).join(F.broadcast(known) if small else known, "term").select("id", "term", "n", "idf")
    if not small:
        # Dealt before anything is computed of it: numbers made of n and idf do not move.
        found = found.where("id is not null").repartition("id")
    raw = F.col("n") * F.col("idf")
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("id")))
    weighed = found.withColumn("length", length).where("id is not null")
    return weighed.select("id", "term", "n", "idf", (raw / F.col("length")).alias("weight"))
