"""The catalogue of corpora and the reading of one corpus."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORCED = "__forced_label"
FILE, ROW = "__file", "__row"
# The columns that a row's split has.
COLUMNS = "__columns"


@dataclass(frozen=True)
class SourceSpec:
    """How to read and label one corpus. ``path`` holds one table or one folder per split."""

    name: str
    text_field: str
    path: str = ""
    format: str = "parquet"
    config: str | None = None
    revision: str | None = None
    split: str | None = None
    split_per_label: dict[str, int] = field(default_factory=dict, hash=False)
    label_field: str | None = None
    label_map: dict = field(default_factory=dict, hash=False)
    fixed_label: int | None = None
    drop_label_values: tuple = ()
    filter: dict = field(default_factory=dict, hash=False)
    language: str | None = None
    language_field: str | None = None
    license: str | None = None
    role: str = "training"
    key_field: str | None = None
    id: str | None = None

    @classmethod
    def from_dict(cls, entry: dict) -> SourceSpec:
        known = {f for f in cls.__dataclass_fields__}
        values = {k: v for k, v in entry.items() if k in known and v is not None}
        if "drop_label_values" in values:
            values["drop_label_values"] = tuple(values["drop_label_values"])
        if "id" not in values:
            values["id"] = next((v for k, v in entry.items() if k.endswith("_id") and v), None)
        return cls(**values)


@dataclass(frozen=True)
class Catalogue:
    """Sources by role, in order; a source's place is its priority when rows are deduplicated."""

    training: list[SourceSpec]
    held_out: list[SourceSpec]
    excluded: list[dict]


def read_catalogue(spark: SparkSession, path: str) -> Catalogue:
    """Reads the JSON catalogue, wherever Spark can read from. Excluded sources are only listed.

    One small document of settings, so its text comes to the driver.
    """
    document = json.loads(spark.read.text(path, wholetext=True).first()[0])
    specs = lambda role: [SourceSpec.from_dict(e) for e in document.get(role, [])]
    return Catalogue(specs("training_pool"), specs("held_out_evaluation"), document.get("excluded", []))


def catalogue_table(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue as rows: role list, position in it, and the source's entry as JSON."""
    document = spark.read.text(path, wholetext=True)
    lists = ["training_pool", "held_out_evaluation", "excluded"]
    parsed = document.select(
        F.from_json("value", ", ".join(f"{name} array<variant>" for name in lists)).alias("c")
    )
    parts = [
        parsed.select(F.lit(name).alias("role_list"), F.posexplode(F.col(f"c.{name}")).alias("pos", "entry"))
        for name in lists
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select(
        "role_list", "pos", F.variant_get("entry", "$.name", "string").alias("name"),
        F.to_json("entry").alias("entry"),
    )


def read_splits(spark: SparkSession, spec: SourceSpec, splits: list[str]) -> dict[str, DataFrame]:
    """One DataFrame per split folder or file under the source's path."""
    base = f"{spec.path.rstrip('/')}/{spec.config}" if spec.config else spec.path.rstrip("/")
    return {s: _load(spark, spec, f"{base}/{s}") for s in splits}


def _load(spark: SparkSession, spec: SourceSpec, path: str) -> DataFrame:
    """The table at a path with its rows' places: split and file name, and row in the file.

    Files of one split may differ in their columns: the schema has all of them, and a row of a file without one
    has null there. Only Parquet tells a row's number; elsewhere a hash of the row stands in, so that a task that
    runs again still finds the same order.
    """
    reader = spark.read.format(spec.format)
    if spec.format in ("parquet", "orc"):
        reader = reader.option("mergeSchema", "true")
    df = reader.load(path)
    file = F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+/[^/]+$", 0)
    row = F.col("_metadata.row_index") if spec.format == "parquet" else F.xxhash64(F.struct("*"))
    return df.select("*", file.alias(FILE), row.alias(ROW))


def split_names(spark: SparkSession, spec: SourceSpec) -> list[str]:
    """The split folders under the source's path, by name; none if files lie there themselves.

    The folders are told from the paths of the files in them; no file is opened.
    """
    base = f"{spec.path.rstrip('/')}/{spec.config}" if spec.config else spec.path.rstrip("/")
    inside = re.compile(re.escape(f"/{base.rsplit('/', 1)[-1]}/") + r"([^/]+)/[^/]+$")
    try:
        files = spark.read.format("binaryFile").load(f"{base}/*/*").inputFiles()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    found = {unquote(m[1]) for f in files if (m := inside.search(f))}
    return sorted(n for n in found if not n.startswith(("_", ".")))


def read_source(
    spark: SparkSession, spec: SourceSpec, splits: dict[str, DataFrame] | None = None
) -> DataFrame:
    """The rows of a source: every split, one named split, or labelled splits.

    ``splits`` gives the splits as DataFrames instead of reading them from the path.
    """
    wanted = list(spec.split_per_label) or ([] if spec.split in (None, "all") else [spec.split])
    if splits is None:
        folders = wanted or split_names(spark, spec)
        if not folders:
            return _load(spark, spec, spec.path)
        splits = read_splits(spark, spec, folders)
    parts = []
    for name in wanted or list(splits):
        part = splits[name]
        # Not the same as null: a column that a split does not have leaves its rows to the source's default.
        part = part.withColumn(COLUMNS, F.lit([c for c in part.columns if c not in (FILE, ROW)]))
        if spec.split_per_label:
            part = part.withColumn(FORCED, F.lit(int(spec.split_per_label[name])))
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
