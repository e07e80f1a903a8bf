"""A training corpus from documents: five stages, each an operator of ``textward.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's documents. All but the last return the columns of the documents they were given.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import public_tokenizers  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from textward.llm import bpe, lines, mixing, rules, simhash  # noqa: E402
from textward.llm.queries import sized, weighted_targets  # noqa: E402
from textward.session import staged  # noqa: E402

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and whole rows as ``_row``: whatever else documents have cannot clash."""
    return docs.select(*[F.col(f"`{c}`") for c in columns], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the list learned from ``labels`` reject.

    Null and blank texts are rejected, having too few words. Repeated rows are judged alike. An empty
    table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    judged, _ = rules.judge(packed(docs, "doc_id", "text"), labels)
    return judged.where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are alike to one kept elsewhere; ``n_chars`` follows the text.

    No document goes, even if no line is left. A null text stays null.
    """
    done = lines.deduplicate(packed(docs, "doc_id", "text"))
    row = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(row.alias("_row")).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of three-word shingles at most two bits apart.

    The smallest doc_id stays. Documents without words are one group. Of equal rows one stays.
    """
    return simhash.deduplicate(docs, shingle=3, radius=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each copy. Documents not taken go."""
    narrow = packed(docs, "doc_id", "source", "text")
    sizes = staged(sized(narrow.drop("_row")).select("source", "size"), "sizes")
    mixed = mixing.mix(sized(narrow).drop("text"), weighted_targets(sizes), F.col("quality"))
    taken = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("_row.*")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, token_ids, token_offsets, decoded_ok) of every row; ``decoded_ok`` tells
    that the ids decode to the text's bytes. A null text has no tokens."""
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), path, check=True)
    return encoded.select(
        "doc_id", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "token_offsets",
        F.col("decodes").alias("decoded_ok"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode_tokens", encode_tokens),
]

# The learned list, the SimHashes and the token ids cannot be expressed in SQL; the tests hold each
# stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each one's result is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
