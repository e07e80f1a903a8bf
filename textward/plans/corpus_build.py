"""Building a labelled corpus: normalize, deduplicate, balance, split, report."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from textward.operators import dedupe, sampling, summaries
from textward.session import staged
from textward.sources import corpus, sinks
from textward.sources.catalogue import Catalogue, SourceSpec, read_source


def labelled_source(
    spark: SparkSession,
    spec: SourceSpec,
    priority: int,
    max_text_chars: int | None = None,
    splits: dict[str, DataFrame] | None = None,
) -> DataFrame:
    raw = read_source(spark, spec, splits)
    return corpus.label_rows(raw, spec, corpus.row_order(raw, priority, spec.key_field), max_text_chars)


def training_rows(
    spark: SparkSession,
    specs: Sequence[SourceSpec],
    max_text_chars: int | None = None,
    splits: dict[str, dict[str, DataFrame]] | None = None,
) -> DataFrame:
    """All training sources, in catalogue order, with skipped rows marked."""
    return corpus.concatenate(
        [
            labelled_source(spark, spec, i, max_text_chars, (splits or {}).get(spec.name))
            for i, spec in enumerate(specs)
        ]
    )


def build(
    spark: SparkSession,
    catalogue: Catalogue,
    out: str,
    target_ratio: float = 0.6,
    max_text_chars: int | None = None,
    seed: int = 7,
    splits: dict[str, dict[str, DataFrame]] | None = None,
    shuffle: bool = True,
) -> dict:
    """Writes the split corpus, the held-out sets, the reports and ``manifest.json``; returns the manifest.

    Sources are read once, into normalized rows. Deduplicating, balancing and splitting work on a table of
    keys and labels without texts; texts move once, when the rows that stay are joined with their split, and
    once more into shuffled order, which ``shuffle`` can turn off. The counts also lie as tables under
    ``reports``, whatever number of sources, languages and labels there is.
    """
    sampling.check_ratio(target_ratio)
    labelled = staged(training_rows(spark, catalogue.training, max_text_chars, splits), "normalized")
    rows = corpus.corpus_rows(labelled)
    keys = staged(dedupe.key_table(rows, "label", "source", "lang"), "keys")
    collisions = dedupe.collisions_of(keys)
    deduped = staged(dedupe.first_of_keys(keys).select("pos", "label", "source", "lang"), "deduplicated")
    final = staged(sampling.split(sampling.balance(deduped, target_ratio, seed), seed), "divided")
    divided = rows.join(final.select("pos", "split"), "pos")
    sinks.write_splits(sampling.shuffled_within(divided, "split", seed) if shuffle else divided, f"{out}/splits")
    sinks.write_report(summaries.source_stats(labelled), f"{out}/reports/sources")
    sinks.write_report(summaries.split_summary(final), f"{out}/reports/splits")

    held_out = {}
    for i, spec in enumerate(catalogue.held_out):
        part = staged(labelled_source(spark, spec, i, max_text_chars, (splits or {}).get(spec.name)), "held-out")
        sinks.write_held_out(corpus.corpus_rows(part), out, spec.name)
        held_out.update(_source_report([spec], part))

    counts = collisions.first()
    stats = sampling.balance_stats(deduped, final, target_ratio).first().asDict()
    manifest = {
        "built_at": dt.datetime.now(dt.timezone.utc).isoformat(),
        "seed": seed,
        "target_ratio": target_ratio,
        "max_text_chars": max_text_chars,
        "training_pool": {
            "per_source": _source_report(catalogue.training, labelled),
            "pre_dedup_total": counts["rows_before"],
            "post_dedup_total": counts["rows_after"],
            "dedup": {
                "exact_collisions": counts["exact_collisions"],
                "near_dup_collisions": counts["near_dup_collisions"],
            },
            "balance": {k: v for k, v in stats.items() if v is not None},
            "splits": _split_report(final),
        },
        "held_out": held_out,
    }
    write_manifest(spark, manifest, out)
    return manifest


def _source_report(specs: Sequence[SourceSpec], labelled: DataFrame) -> dict:
    """Counts per source and label: a few rows, whatever the corpus."""
    labels: dict[str, dict[str, int]] = {}
    for r in summaries.label_counts(labelled).collect():
        labels.setdefault(r["source"], {})[str(r["label"])] = r["n"]
    found = {r["source"]: r for r in summaries.source_stats(labelled).collect()}
    report = {}
    for spec in specs:
        r = found.get(spec.name)
        report[spec.name] = {
            "raw_rows_after_filter": r["raw_rows_after_filter"] if r else 0,
            "kept_rows": r["kept_rows"] if r else 0,
            "skipped_rows": r["skipped_rows"] if r else 0,
            "label_counts": labels.get(spec.name, {}),
            "id": spec.id,
            "requested_revision": spec.revision or "main",
        }
    return report


def _split_report(divided: DataFrame) -> dict:
    report: dict = {
        s: {"total": 0, "by_source": {}, "by_lang": {}, "by_label": {}} for s in ("train", "val", "test")
    }
    for r in summaries.split_summary(divided).collect():
        entry = report[r["split"]]
        if r["dimension"] == "total":
            entry["total"] = r["n"]
        else:
            entry[r["dimension"]][r["value"]] = r["n"]
    return report


def write_manifest(spark: SparkSession, manifest: dict, out: str) -> None:
    text = json.dumps(manifest, indent=2, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{out}/manifest.json"
    )


def read_manifest(spark: SparkSession, out: str) -> dict:
    return json.loads(spark.read.text(f"{out}/manifest.json", wholetext=True).first()[0])
