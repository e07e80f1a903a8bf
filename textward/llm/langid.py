"""Language of web pages: Bayesian fusion of text, markup, address and host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textward.session import staged

_TAG = re.compile(r"<[^<>]*>")
_NAME = re.compile(r"<\s*(/?)\s*([A-Za-z0-9]+)")
_HIDDEN = {"script", "style", "noscript", "template"}


@dataclass(frozen=True)
class Settings:
    languages: tuple[str, ...] = ("de", "en", "es", "fr")
    buckets: int = 1 << 15  # of hashed trigrams of bytes
    smoothing: float = 0.5  # added to each bucket's count
    # Trigrams overlap and words repeat: so much of their log likelihood counts.
    text_share: float = 0.2
    evidence_smoothing: float = 1.0  # pages added to each count of a declared language or a suffix
    prior_pages: float = 4.0  # pages that a level's prior is worth to the level below


def trigrams(text: str, buckets: int) -> np.ndarray:
    """Buckets of a text's trigrams of lower-case UTF-8."""
    b = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.empty(0, np.int64)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]).astype(np.uint64)
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def visible(page: str) -> str:
    """The text of a page: no tags, comments, scripts or styles; entities decoded. Any markup ends."""
    out, at, hidden = [], 0, ""
    for tag in _TAG.finditer(page):
        if not hidden:
            out.append(page[at : tag.start()])
        at = tag.end()
        name = _NAME.match(tag[0])
        if name:
            closing, word = name[1], name[2].lower()
            if hidden:
                hidden = "" if closing and word == hidden else hidden
            elif word in _HIDDEN and not closing:
                hidden = word
    if not hidden:
        out.append(page[at:])
    return html.unescape(" ".join(out))


def train(texts: DataFrame, settings: Settings, text: str = "text", lang: str = "lang") -> np.ndarray:
    """(buckets, languages) log likelihoods, from trigram counts of all texts in the languages.

    Tasks count into a table of fixed size, Spark adds the tables, the driver sees one.
    """
    places = {l: i for i, l in enumerate(settings.languages)}
    rows = texts.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isin(*places))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(places), settings.buckets), np.int64)
        for batch in batches:
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[places[l]] += np.bincount(trigrams(t or "", settings.buckets), minlength=settings.buckets)
        l, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(l, pa.int64()), pa.array(b, pa.int64()), pa.array(total[l, b])], names=["l", "b", "n"])

    counted = rows.mapInArrow(count, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n")).collect()
    table = np.full((settings.buckets, len(places)), settings.smoothing)
    for l, b, n in counted:
        table[b, l] += n
    return np.log(table / table.sum(axis=0))


def host_of(url: Column) -> Column:
    """Lower-case host of an address without port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@\s]+)", 1)), F.lit(""))


def declared_of(page: Column) -> Column:
    """Primary subtag of the language that a page's html tag declares, lower case; empty if none."""
    return F.coalesce(F.lower(F.regexp_extract(page, r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,8})", 1)), F.lit(""))


def evidence(pages: DataFrame, table: np.ndarray, settings: Settings, id: str = "page_id") -> DataFrame:
    """(id, host, domain, suffix, declared, text) of pages; text is an array of log likelihoods, already
    lessened by ``text_share``."""
    base = pages.select(
        F.col(id).alias("id"), host_of(F.col("url")).alias("host"), declared_of(F.col("html")).alias("declared"), F.col("html")
    )
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            found = [
                (logs[trigrams(visible(page or ""), settings.buckets)].sum(axis=0) * settings.text_share).tolist()
                for page in batch.column(3).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(found, pa.list_(pa.float64()))], names=["id", "host", "declared", "text"])

    kind = base.select("id").schema[0].dataType.simpleString()
    read_pages = base.mapInArrow(read, f"id {kind}, host string, declared string, text array<double>")
    labels = F.split("host", r"\.")
    return read_pages.withColumns({
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        "suffix": F.element_at(labels, -1),
    })


def _softmax(logs: Column) -> Column:
    raised = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, texts: DataFrame, settings: Settings | None = None, id: str = "page_id") -> DataFrame:
    """(page_id, host, declared, text_lang, lang, probability) of every page (page_id, url, html).

    The posterior of a language is the product of the text's likelihood, that of the declared markup
    language and of the address suffix given the language, and a prior of the host. The last three
    come from grouped sums, over all pages, of what the text alone says. The host's prior leans on
    its domain's, and that on all pages', each worth ``prior_pages``; a page's own text is taken out
    of the sums that it meets again, so it does not vote twice.

    ``texts`` (text, lang) trains the text part. A null page, text, address or declaration is an empty
    one and says nothing; with nothing at all a page has the prior of all pages. Equal likelihoods
    go to the first language by name. Repeated rows repeat and count each. Without pages the result
    is empty; without training texts all languages are alike in the text.
    """
    settings = settings or Settings()
    k = len(settings.languages)
    seen = staged(evidence(pages, train(texts, settings), settings, id).withColumn("alone", _softmax(F.col("text"))), "evidence")

    def sums(*by: str) -> DataFrame:
        return seen.groupBy(*by).agg(F.array(*[F.sum(F.col("alone")[i]) for i in range(k)]).alias("n"))

    tables = {
        "of_host": staged(sums("host"), "hosts"), "of_domain": staged(sums("domain"), "domains"),
        "of_declared": staged(sums("declared"), "declared"), "of_suffix": staged(sums("suffix"), "suffixes"),
    }
    key = {"of_host": "host", "of_domain": "domain", "of_declared": "declared", "of_suffix": "suffix"}
    every = seen.agg(F.array(*[F.coalesce(F.sum(F.col("alone")[i]), F.lit(0.0)) for i in range(k)]).alias("n"), F.count_distinct("declared"), F.count_distinct("suffix")).first()
    total = F.lit([float(x) for x in every[0]])
    joined = seen
    for name, table in tables.items():
        joined = joined.join(table.withColumnRenamed("n", name), key[name])
    without = lambda n: F.zip_with(n, "alone", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    added = lambda n: F.aggregate(n, F.lit(0.0), lambda a, b: a + b)
    lean = F.lit(settings.prior_pages)

    def level(n: Column, above: Column) -> Column:
        return F.zip_with(n, above, lambda a, p: (a + lean * p) / (added(n) + lean))

    def given(name: str, kinds: int, empty: str) -> Column:
        """Log chance of the page's value given each language; nothing if the value is empty."""
        s = F.lit(settings.evidence_smoothing)
        chance = F.zip_with(without(F.col(name)), without(total), lambda a, b: F.log((a + s) / (b + s * max(kinds, 1))))
        return F.when(F.col(empty) == "", F.array_repeat(F.lit(0.0), k)).otherwise(chance)

    even = F.array_repeat(F.lit(1.0 / k), k)
    joined = joined.withColumn("all", level(without(total), even))
    joined = joined.withColumn("p_domain", level(without(F.col("of_domain")), F.col("all")))
    joined = joined.withColumn("prior", level(without(F.col("of_host")), F.col("p_domain")))
    joined = joined.withColumns({"by_declared": given("of_declared", every[1], "declared"), "by_suffix": given("of_suffix", every[2], "suffix")})
    logs = F.transform("text", lambda x, i: x + F.log(F.get("prior", i)) + F.get("by_declared", i) + F.get("by_suffix", i))
    final = joined.withColumn("posterior", _softmax(logs))
    names = F.lit(list(settings.languages))
    first = lambda p: F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    return final.select(
        F.col("id").alias(id), "host", "declared", first(F.col("alone")).alias("text_lang"),
        first(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"),
    )
