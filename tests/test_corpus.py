"""What deduplication, balancing and splitting promise, on random corpora."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textward.operators import dedupe, sampling, summaries
from textward.plans import corpus_build
from textward.sources import corpus, sinks
from textward.sources.catalogue import Catalogue, SourceSpec, catalogue_table, read_catalogue, read_source


def folded(text):
    return text.lower().strip()


def first_of_each(rows):
    """The smallest position of each folded text, and its text."""
    first = {}
    for pos, text in sorted(rows, reverse=True):
        first[folded(text)] = (pos, text)
    return first


@pytest.mark.parametrize("seed", [1, 2])
def test_one_row_of_each_key_stays(spark, seed):
    rng = random.Random(seed)
    bases = ["a" * 300, "b" * 310, "Hello", " hello ", "HELLO", "x y", "", " ", "é", "É"]
    rows = [(i, rng.choice(bases) + rng.choice(["", "", "1", " tail"])) for i in range(800)]
    rng.shuffle(rows)
    first = first_of_each(rows)
    df = spark.createDataFrame(rows, "pos long, text string").repartition(8)
    kept = sorted(pos for pos, _ in first.values())
    assert sorted(r["pos"] for r in dedupe.keep_first(df).collect()) == kept
    assert sorted(r["pos"] for r in dedupe.kept_positions(df).collect()) == kept
    c = dedupe.collision_counts(df).first()
    assert (c["rows_before"], c["rows_after"]) == (800, len(kept))
    assert c["exact_collisions"] + c["near_dup_collisions"] == 800 - len(kept)
    # A collision is exact when the row that stays has the very same text.
    assert c["exact_collisions"] == sum(text == first[folded(text)][1] for _, text in rows) - len(kept)


def test_texts_that_differ_after_300_characters_stay(spark):
    rows = [(0, "a" * 301 + "x"), (1, "a" * 301 + "y")]
    df = spark.createDataFrame(rows, "pos long, text string")
    assert dedupe.keep_first(df).count() == 2 and dedupe.keep_first(df, prefix_chars=300).count() == 1


def test_near_copy_before_its_exact_copy(spark):
    rows = [(0, "Hello"), (1, "hello"), (2, "hello"), (3, "Hello")]
    c = dedupe.collision_counts(spark.createDataFrame(rows, "pos long, text string")).first()
    assert (c["exact_collisions"], c["near_dup_collisions"]) == (1, 2)


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(i, "same") for i in range(10)], "pos long, text string")
    plan = dedupe.keep_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


def test_empty_input(spark):
    df = spark.createDataFrame([], "pos long, text string")
    c = dedupe.collision_counts(df).first()
    assert (c["rows_before"], c["rows_after"], c["exact_collisions"], c["near_dup_collisions"]) == (0, 0, 0, 0)


def hash_of(seed, pos):
    return hashlib.sha256(f"{seed}|{pos}".encode()).hexdigest()


def make_rows(n, seed, positive=0.2, labels=(0, 1)):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        label = 1 if rng.random() < positive else 0
        if len(labels) > 2 and rng.random() < 0.05:
            label = 2
        # Half of all rows in one stratum; others as small as one row; some keys null.
        source = "hot" if rng.random() < 0.5 else f"s{int(rng.random() ** 3 * 40)}"
        lang = None if rng.random() < 0.1 else rng.choice(["en", "en", "es", "fr"])
        rows.append((i, label, source, lang))
    return rows


SCHEMA = "pos long, label int, source string, lang string"


@pytest.mark.parametrize("n,positive,ratio", [(3000, 0.2, 0.6), (500, 0.1, 0.3), (300, 0.05, 0.9), (400, 0.9, 0.6)])
def test_balance(spark, n, positive, ratio):
    rows = make_rows(n, n, positive, labels=(0, 1, 2))
    kept = {r["pos"] for r in sampling.balance(spark.createDataFrame(rows, SCHEMA), ratio).collect()}
    positives = {p for p, label, *_ in rows if label == 1}
    negatives = {p: (source, lang) for p, label, source, lang in rows if label == 0}
    assert positives <= kept <= positives | set(negatives)
    wanted = sampling.desired_negatives(len(positives), ratio)
    left = kept - positives
    if len(negatives) <= wanted:
        assert left == set(negatives)
        return
    # Each stratum may give its share, smallest hashes first; together they give what is wanted,
    # and what is left out of the shares has larger hashes than all that stayed.
    offered = set()
    for stratum in set(negatives.values()):
        members = sorted((p for p in negatives if negatives[p] == stratum), key=lambda p: hash_of(7, p))
        share = round(wanted * len(members) / len(negatives))
        offered |= set(members[: max(share, 1)])
    assert left <= offered and len(left) == min(wanted, len(offered))
    assert max(map(lambda p: hash_of(7, p), left)) < min((hash_of(7, p) for p in offered - left), default="~")


def test_balance_with_one_class_changes_nothing(spark):
    rows = [(i, 0, "a", "en") for i in range(10)] + [(10, 2, "a", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sampling.balance(df).count() == 11
    s = sampling.balance_stats(df, sampling.balance(df)).first()
    assert (s["kept_pos"], s["kept_neg"], s["subsampled"], s["desired_neg"], s["neg_strata"]) == (0, 10, False, None, None)
    for bad in (0.0, 1.0, -1, 2):
        with pytest.raises(ValueError):
            sampling.balance(df, bad)


@pytest.mark.parametrize("n", [1, 40, 2500])
def test_split(spark, n):
    rows = make_rows(n, n)
    got = {r["pos"]: r["split"] for r in sampling.split(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {r[0] for r in rows}
    for stratum in {(r[2], r[1]) for r in rows}:
        hashes = {"train": [], "val": [], "test": []}
        for pos, label, source, _ in rows:
            if (source, label) == stratum:
                hashes[got[pos]].append(hash_of("7-split", pos))
        size = sum(map(len, hashes.values()))
        assert len(hashes["train"]) == round(0.8 * size)
        assert len(hashes["val"]) == min(round(0.1 * size), size - len(hashes["train"]))
        assert max(hashes["train"], default="") < min(hashes["val"] + hashes["test"], default="~")
        assert max(hashes["val"], default="") < min(hashes["test"], default="~")


def test_small_strata_split_counts(spark):
    rows, pos = [], 0
    for size in (1, 4, 5, 15):
        for _ in range(size):
            rows.append((pos, 0, f"n{size}", "en"))
            pos += 1
    got = Counter((r["source"], r["split"]) for r in sampling.split(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == {
        ("n1", "train"): 1, ("n4", "train"): 3, ("n4", "test"): 1, ("n5", "train"): 4, ("n5", "test"): 1,
        ("n15", "train"): 12, ("n15", "val"): 2, ("n15", "test"): 1,
    }


def test_known_manifest_counts():
    assert sampling.desired_negatives(8734, 0.6) == 5823


def test_no_window_over_a_whole_stratum(spark):
    """Rows are ranked inside (stratum, bucket), never inside a stratum."""
    rows = make_rows(200, 9)
    plan = sampling.split(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


# ---- sources ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def corpora(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("corpora"))

    def write(rows, schema, path):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/{path}")

    write([(f" text {i} ", i % 2) for i in range(40)], "text string, label int", "ints/train")
    write([(f"text {i}", 1) for i in range(5)] + [(None, 1), ("  ", 0), ("no label", None)], "text string, label int", "ints/test")
    write([(f"prompt {i}", i % 4 == 0) for i in range(60)] + [("TEXT 3", True)], "prompt string, jailbreak boolean", "bools/train")
    write([(f"msg {i}", "prompter" if i % 2 else "assistant", None if i % 3 else "p", "es" if i % 5 else "") for i in range(60)]
          + [("null role", None, None, "fr")], "text string, role string, parent_id string, lang string", "tree/train")
    write([("goal a",), ("goal b",)], "Goal string", "beh/behaviors/harmful")
    write([("goal a",)], "Goal string", "beh/behaviors/benign")
    spark.createDataFrame([("p1", "BLOCKED", "Spanish"), ("p2", "VARIES", "x"), ("p3", "PASS", "")], "prompt string, expected string, language string").write.json(f"{base}/held/all")
    catalogue = {
        "training_pool": [
            {"name": "ints", "some_id": "o/ints", "revision": "main", "split": "all", "text_field": "text", "label_field": "label", "language": "en", "path": f"{base}/ints"},
            {"name": "bools", "split": "train", "text_field": "prompt", "label_field": "jailbreak", "language": "en", "path": f"{base}/bools"},
            {"name": "tree", "split": "train", "text_field": "text", "label_field": None, "fixed_label": 0, "filter": {"role": "prompter", "parent_id_is_null": True}, "language": "multi", "path": f"{base}/tree"},
        ],
        "held_out_evaluation": [
            {"name": "davidtkeane_prompt_injection", "format": "json", "split": "all", "text_field": "prompt", "label_field": "expected", "label_map": {"BLOCKED": 1, "PASS": 0}, "drop_label_values": ["VARIES"], "language_field": "language", "path": f"{base}/held"},
            {"name": "beh", "config": "behaviors", "split_per_label": {"harmful": 1, "benign": 0}, "text_field": "Goal", "language": "en", "path": f"{base}/beh"},
        ],
        "excluded": [{"name": "left_out", "reason": "license"}],
    }
    path = f"{base}/sources.json"
    with open(path, "w") as f:
        json.dump(catalogue, f)
    return base, path


def test_catalogue(spark, corpora):
    catalogue = read_catalogue(spark, corpora[1])
    assert [s.name for s in catalogue.training] == ["ints", "bools", "tree"]
    assert catalogue.training[0].id == "o/ints" and catalogue.excluded[0]["name"] == "left_out"
    rows = catalogue_table(spark, corpora[1]).orderBy("role_list", "pos").collect()
    assert [(r["role_list"], r["pos"], r["name"]) for r in rows] == [
        ("excluded", 0, "left_out"), ("held_out_evaluation", 0, "davidtkeane_prompt_injection"), ("held_out_evaluation", 1, "beh"),
        ("training_pool", 0, "ints"), ("training_pool", 1, "bools"), ("training_pool", 2, "tree"),
    ]


def test_splits_and_labels(spark, corpora):
    catalogue = read_catalogue(spark, corpora[1])
    assert read_source(spark, catalogue.training[0]).count() == 48
    beh = corpus_build.labelled_source(spark, catalogue.held_out[1], 0)
    assert sorted((r["text"], r["label"]) for r in beh.collect()) == [("goal a", 0), ("goal a", 1), ("goal b", 1)]
    held = corpus.corpus_rows(corpus_build.labelled_source(spark, catalogue.held_out[0], 0))
    assert sorted((r["text"], r["label"], r["lang"]) for r in held.collect()) == [("p1", 1, "Spanish"), ("p3", 0, "en")]
    tree = corpus.corpus_rows(corpus_build.labelled_source(spark, catalogue.training[2], 2)).collect()
    want = [(f"msg {i}", "es" if i % 5 else "en") for i in range(60) if i % 2 and i % 3]
    assert sorted((r["text"], r["lang"]) for r in tree) == sorted(want)
    ints = summaries.source_stats(corpus_build.labelled_source(spark, catalogue.training[0], 0)).first()
    assert (ints["raw_rows_after_filter"], ints["kept_rows"], ints["skipped_rows"]) == (48, 45, 3)


def test_whole_build(spark, corpora, tmp_path):
    out = str(tmp_path / "built")
    catalogue = read_catalogue(spark, corpora[1])
    manifest = corpus_build.build(spark, catalogue, out, target_ratio=0.6)
    assert corpus_build.read_manifest(spark, out) == manifest
    pool = manifest["training_pool"]
    labelled = corpus_build.training_rows(spark, catalogue.training)
    kept = corpus.corpus_rows(labelled).select("pos", "text", "label").orderBy("pos").collect()
    positions = sorted(pos for pos, _ in first_of_each([(i, r["text"]) for i, r in enumerate(kept)]).values())
    assert pool["pre_dedup_total"] == len(kept) and pool["post_dedup_total"] == len(positions)
    assert pool["dedup"] == {"exact_collisions": 5, "near_dup_collisions": 1}
    positives = sum(kept[i]["label"] == 1 for i in positions)
    assert pool["balance"]["kept_pos"] == positives
    assert pool["balance"]["kept_neg"] == pool["balance"]["desired_neg"] == sampling.desired_negatives(positives, 0.6)
    final = spark.read.parquet(f"{out}/splits")
    assert sum(s["total"] for s in pool["splits"].values()) == final.count() == positives + pool["balance"]["kept_neg"]
    assert final.filter(F.length("text") != F.col("length")).isEmpty()
    assert spark.read.parquet(f"{out}/eval_davidtkeane.parquet").count() == 2
    assert spark.read.parquet(f"{out}/eval_beh.parquet").count() == 3
    assert manifest["held_out"]["beh"]["label_counts"] == {"0": 1, "1": 2}
    again = corpus_build.build(spark, catalogue, str(tmp_path / "again"), target_ratio=0.6)
    texts = lambda path: sorted((r["text"], r["split"]) for r in spark.read.parquet(f"{path}/splits").collect())
    assert texts(out) == texts(str(tmp_path / "again")) and again["training_pool"]["splits"] == pool["splits"]


def test_truncation_is_not_stripped_again(spark):
    spec = SourceSpec("s", "text", fixed_label=0)
    df = spark.createDataFrame([(0, "  abcd efg ")], "k long, text string")
    r = corpus.corpus_rows(corpus.label_rows(df, spec, corpus.row_order(df, 0, "k"), 5)).first()
    assert r["text"] == "abcd " and r["length"] == 5
    numbers = spark.createDataFrame([(0, 3)], "k long, text int")
    assert not corpus.label_rows(numbers, spec, F.col("k")).first()["kept"]


def test_empty_sink(spark, tmp_path):
    assert not sinks.write_table(spark.range(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_shuffled_order(spark):
    df = spark.createDataFrame([(i, "t") for i in range(50)], "pos long, text string")
    got = [r["pos"] for r in sampling.shuffled(df).collect()]
    assert got == sorted(range(50), key=lambda p: hash_of("7-order", p)) and got != list(range(50))


def test_rows_of_a_split_lie_in_shuffled_order(spark, tmp_path):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(400)], "pos long, split string").repartition(6)
    sinks.write_splits(sampling.shuffled_within(df, "split"), str(tmp_path / "s"))
    for split in ("a", "b"):
        got = [r["pos"] for f in sorted((tmp_path / "s" / f"split={split}").glob("part-*")) for r in spark.read.parquet(str(f)).collect()]
        assert got == sorted((i for i in range(400) if ("a" if i % 3 else "b") == split), key=lambda p: hash_of("7-order", p))


def test_a_build_without_kept_rows(spark, tmp_path):
    raw = spark.createDataFrame([(1, None, 1), (2, " ", 0)], "k long, text string, label int")
    spec = SourceSpec("none", "text", label_field="label", key_field="k")
    manifest = corpus_build.build(spark, Catalogue([spec], [], []), str(tmp_path / "out"), splits={"none": {"all": raw}})
    pool = manifest["training_pool"]
    assert (pool["pre_dedup_total"], pool["post_dedup_total"], pool["per_source"]["none"]["skipped_rows"]) == (0, 0, 2)
    assert all(s["total"] == 0 for s in pool["splits"].values())


def test_first_rows_of_keys_from_a_key_table(spark):
    rows = [(i, "hot" if i % 2 else f"t{i % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "pos long, text string").repartition(8)
    keys = dedupe.key_table(df)
    assert sorted(r["pos"] for r in dedupe.first_of_keys(keys).collect()) == sorted(p for p, _ in first_of_each(rows).values())
    assert dedupe.collisions_of(keys).first() == dedupe.collision_counts(df).first()
