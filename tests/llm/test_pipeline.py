import corpus_pipeline as pipeline
import pytest

from .test_rules import SF, plain_statistics
from .test_simhash import plain_fingerprint, plain_groups


@pytest.fixture(scope="module")
def stages(spark):
    """What went into and what came out of each stage."""
    from textward.session import staged

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        done = staged(stage(spark, docs, SF), name)
        out[name] = (docs, done)
        docs = done
    return out


def test_columns_stay(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.dtypes == before.dtypes, name


def test_rejected_documents_go(stages):
    before, after = stages["quality_rules"]
    left = {r.doc_id for r in after.collect()}
    for r in before.collect():
        n, _, symbols, _, repeated = plain_statistics(r.text)
        if n < 20 or 100 * repeated > 30 * n or symbols > n:
            assert r.doc_id not in left
        elif symbols == 0 and repeated == 0 and len(set(r.text.split())) > 0.6 * n:
            assert r.doc_id in left


def test_lines_go_and_documents_stay(stages):
    before, after = stages["line_dedup"]
    texts = {r.doc_id: r.text for r in before.collect()}
    seen = []
    for r in after.collect():
        rest = iter(texts[r.doc_id].split("\n"))
        assert not r.text or all(line in rest for line in r.text.split("\n"))
        assert r.n_chars == len(r.text)
        seen += [line for line in r.text.split("\n") if any(map(str.isalnum, line))]
    assert after.count() == before.count() and len(seen) == len(set(seen))


def test_one_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    fps = {r.doc_id: plain_fingerprint(r.text, 3) for r in before.collect()}
    group = plain_groups(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(group.values()))


def test_mixed_and_encoded(spark, stages):
    before, after = stages["mix_sources"]
    assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in before.collect()}
    assert max(r["count"] for r in after.groupBy("doc_id").count().collect()) <= 3
    encoded = stages["encode_tokens"][1]
    assert encoded.count() == after.count() and encoded.where("not decoded_ok or n_tokens <> size(token_ids)").isEmpty()
    key = lambda rows: sorted((r.doc_id, r.n_tokens) for r in rows)
    assert key(pipeline.run(spark, SF).collect()) == key(encoded.collect())


def test_odd_rows_pass_every_stage(spark, odd, none):
    docs = odd.withColumnRenamed("fp", "kept").withColumnRenamed("size", "copies")
    for name, stage in pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            rows = out.collect()
            if name != "encode_tokens":
                assert out.dtypes == docs.dtypes, name
            if name in ("line_dedup", "encode_tokens"):
                assert len(rows) == table.count()
